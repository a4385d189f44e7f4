"""Queries on reports, layouts and recordings over the conversations' syllables and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kavyamill import dims
from kavyamill.functions import prosody as P
from kavyamill.operators import attempts as A
from kavyamill.operators import checks as K
from kavyamill.operators import meter as M
from kavyamill.operators import report as R
from kavyamill.operators import verse as V
from kavyamill.plans.prosody import LG
from kavyamill.plans.registry import dealt, query, table, values

_ROWS = {r[1]: r for r in dims.meter_rows()}
_ELEVENS = [r for r in dims.meter_rows() if all(len(p) == 11 for p in r[6])]
_MIXED = dims.UPAJATI[0]
_SIBLINGS = [_ROWS[x][5][0][:10] for x in _MIXED[2:]]
_SPOKEN = lambda feet: " / ".join(" · ".join(R.FOOT_NAMES[c] for c in code if c in R.FOOT_NAMES) for code in feet)
_KNOWN = values([(r[1], r[2], _SPOKEN(r[4]), *(p[:10] for p in r[6])) for r in _ELEVENS], "id, name, formula, a, b, c, d")
#: In DuckDB: stanzas of the turns, and the first candidate of each.
_FIRST = f"""t AS (SELECT conv_id, turn, {LG} AS w FROM conversations),
s AS (SELECT conv_id, turn, s, list_transform(range(4), lambda k: array_to_string(w[s * 44 + k * 11 + 1:s * 44 + k * 11 + 10], '')) AS p FROM (SELECT conv_id, turn, w, unnest(range(len(w) // 44)) AS s FROM t)),
d AS (SELECT conv_id, turn, s, p, id, hamming(p[1], a) + hamming(p[2], b) + hamming(p[3], c) + hamming(p[4], d) AS distance FROM s CROSS JOIN {_KNOWN}
UNION ALL SELECT conv_id, turn, s, p, '{_MIXED[0]}', 0 FROM s WHERE list_sort(list_distinct(p)) = list_sort({_SIBLINGS})),
f AS (SELECT conv_id, turn, s, any_value(p) AS p, min(distance) AS distance, arg_min(id, (distance, id)) AS id, count(*) FILTER (WHERE distance = 0) AS exact FROM d GROUP BY conv_id, turn, s),
v AS (SELECT f.*, coalesce(k.name, '{_MIXED[1]}') AS name, k.formula, CASE WHEN exact = 0 THEN 'unidentified' WHEN exact > 1 THEN 'ambiguous' WHEN f.id IN {dims.DUAL_AUTHORITY} THEN 'identified' ELSE 'provisional' END AS status FROM f LEFT JOIN {_KNOWN.replace(') AS t(', ') AS k(')} USING (id))"""
_LINES = " ".join(f"WHEN len(list_filter(p, lambda x: x = '{q[:-1]}')) = 4 THEN '{name}'" for name, q in V.LINE_METERS if len(q) == 11)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = dealt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")
    return turns.select("conv_id", "turn", P.pattern(P.letters(F.col("text"))).alias("p"))


def _stanzas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stanzas of the turns: 44 syllables read as four lines of eleven, in the classical tradition."""
    rows = _turns(spark, sf_dir).select("conv_id", "turn", F.posexplode_outer(F.regexp_extract_all("p", F.lit("(.{44})"), F.lit(1))).alias("s", "p")).where("p is not null")
    return rows.select("conv_id", "turn", "s", F.array(*[F.substring("p", 11 * i + 1, 11) for i in range(4)]).alias("units"), F.lit("classical").alias("asked"))


@query(f"""WITH {_FIRST}
SELECT conv_id, turn, CAST(s AS BIGINT) AS stanza, status, name, formula, CASE WHEN status = 'unidentified' THEN 'unidentified metre' ELSE name || CASE WHEN contains(name, 'triṣṭubh') THEN ' — 11 akṣara' ELSE ' (triṣṭubh — 11 akṣara)' END || CASE status WHEN 'identified' THEN '' ELSE ' — ' || status END END AS label,
CASE status WHEN 'ambiguous' THEN exact || ' candidates are equally good; none was preferred.' WHEN 'provisional' THEN 'The pattern agrees, but root and commentary are not both on record for this meter.' WHEN 'unidentified' THEN 'Nothing agrees exactly; the nearest meters of this length are listed.' END AS diagnostic,
CASE {_LINES} WHEN len(list_filter(p, lambda x: x IN ('{_SIBLINGS[0]}', '{_SIBLINGS[1]}'))) = 4 THEN '{V.LINE_FAMILIES[0][0]}' ELSE 'unidentified' END AS line_label FROM v""")
def turn_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of the report on every stanza of every turn, and the name that the line identifier gives it."""
    shown = R.summary(R.of_rows(_stanzas(spark, sf_dir).withColumn("lines", F.col("units"))))
    return shown.select("conv_id", "turn", F.col("s").cast("long").alias("stanza"), "status", "name", F.col("gana_formula").alias("formula"), "label", F.get("diagnostics", F.lit(0)).alias("diagnostic"), V.line_identity(F.col("lines"))["label"].alias("line_label"))


#: Fields of the first candidate that are forged, and what the checker must say; after these the report's own flag is, or nothing.
_FIELDS = ("name", "notes", "template", "subtypes", "yati")
_CODES = ("NAME_CHANGED", "FIXED_NOTES_CHANGED", "TEMPLATE_CHANGED", "FIXED_SUBTYPES_CHANGED", "YATI_CHANGED")


@query(f"""WITH {_FIRST}, k AS (SELECT *, (conv_id + turn + s) % {len(_FIELDS) + 2} AS kind FROM v)
SELECT conv_id, turn, CAST(s AS BIGINT) AS stanza, ({list(_CODES) + ['IDENTIFIED_FLAG_MISMATCH']})[kind + 1] AS code FROM k WHERE kind < {len(_FIELDS)} AND id <> '{_MIXED[0]}' OR kind = {len(_FIELDS)}""")
def forged_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checker says of the reports on all stanzas of the turns after one thing in each, but every seventh, was forged."""
    stanzas = _stanzas(spark, sf_dir).select(F.struct("conv_id", "turn", "s").alias("verse_id"), "units", "asked", F.col("units").alias("given"))
    reports = R.of_rows(stanzas)
    kind = (F.col("verse_id.conv_id") + F.col("verse_id.turn") + F.col("verse_id.s")) % (len(_FIELDS) + 2)
    item = reports.schema["candidates"].dataType.elementType
    forged = {"name": F.lit("forged"), "notes": F.array(F.lit("forged")), "template": F.lit("forged"), "subtypes": F.array(F.lit("forged")), "yati": F.array(F.lit(5))}

    def change(c, i):
        for k, field in enumerate(_FIELDS):
            c = c.withField(field, F.when((i == 0) & (F.col("kind") == k), forged[field].cast(item[field].dataType)).otherwise(c[field]))
        return c

    changed = reports.withColumn("kind", kind).withColumn("candidates", F.transform("candidates", change))
    changed = changed.withColumn("identified", F.when(F.col("kind") == len(_FIELDS), ~F.col("identified")).otherwise(F.col("identified"))).drop("kind")
    found = K.of_rows(changed)
    return found.select("verse_id.conv_id", "verse_id.turn", F.col("verse_id.s").cast("long").alias("stanza"), "code")


#: Layouts of a turn's syllables: name, lengths of the lines, tradition.
_LAYOUTS = (("three eights", (8, 8, 8), "vedic"), ("short third", (8, 8, 7), "vedic"), ("sloka", (8, 8, 8, 8), "classical"), ("one line", (11,), "classical"))
_PARTIAL = values([(r[1], r[5][0], r[9]) for r in dims.meter_rows() if r[3] == "sama-vrtta" and len(r[5][0]) == 11], "id, q, policy")
_EIGHTS = values([(r[1], *r[6], r[9] == "bidirectional") for r in dims.meter_rows() if all(len(p) == 8 for p in r[6])], "id, a, b, c, d, free")
_EIGHT_FITS = " AND ".join(f"x[{8 * i + 1}:{8 * i + 7}] = left({q}, 7) AND (free OR {q}[8] = 'G' OR x[{8 * i + 8}] = {q}[8])" for i, q in enumerate("abcd"))
_LASTS = " AND ".join(f"length(x[{8 * i + 1}:{8 * i + 8}]) + length(replace(x[{8 * i + 1}:{8 * i + 8}], 'L', '')) = {m}" for i, m in enumerate((12, 15, 12, 15)))
_ODD = "(x[2:3] = 'LL')::INT + (NOT (x[5:7] = 'LGG' OR x[2:7] IN ('GLGGGG', 'GLGGLL', 'GGGGLL') OR x[4:7] IN ('GLLL', 'GGLG')))::INT"
_EVEN = "(x[2:3] = 'LL')::INT + (x[2:4] = 'GLG')::INT + (x[5:7] <> 'LGL')::INT"


@query(f"""WITH t AS (SELECT conv_id, turn, array_to_string({LG}, '') AS p FROM conversations),
r AS (SELECT conv_id, turn, layout, n, unnest(range(len(p) // n)) AS k, p FROM t, (VALUES {', '.join(f"('{name}', {sum(sizes)})" for name, sizes, _ in _LAYOUTS)}) AS l(layout, n)),
c AS (SELECT conv_id, turn, layout, k, p[k * n + 1:k * n + n] AS x FROM r),
o AS (SELECT conv_id, turn, layout, k, list_sum(list_transform(range(4), lambda i: CASE WHEN i % 2 = 0 THEN {_ODD.replace('x[', 'c.x[i * 8 + 1:i * 8 + 8][')} ELSE {_EVEN.replace('x[', 'c.x[i * 8 + 1:i * 8 + 8][')} END)) AS wrong FROM c WHERE layout = 'sloka'),
g AS (SELECT conv_id, turn, layout, k, min(id) AS fixed, count(*) AS tied FROM (SELECT c.*, t.id FROM c JOIN {_EIGHTS} ON {_EIGHT_FITS} WHERE layout = 'sloka' UNION ALL SELECT c.*, 'upagiti' FROM c WHERE layout = 'sloka' AND {_LASTS} AND regexp_matches(x, '^{K.HALVES["second"]}{K.HALVES["second"]}$')) GROUP BY ALL),
m AS (SELECT conv_id, turn, layout, k, min(id) AS id FROM c JOIN {_PARTIAL} ON left(x, 10) = left(q, 10) AND (x[11] = q[11] OR policy = 'bidirectional' OR q[11] = 'G') WHERE layout = 'one line' GROUP BY ALL)
SELECT conv_id, turn, layout, CAST(k AS BIGINT) AS k, CASE WHEN layout = 'one line' THEN CASE WHEN m.id IS NULL THEN 'unidentified' ELSE 'insufficient-evidence' END WHEN g.tied + (wrong = 0)::INT > 1 THEN 'ambiguous' ELSE 'provisional' END AS status, CASE layout WHEN 'three eights' THEN 'vedic-gayatri' WHEN 'short third' THEN 'vedic-gayatri-nicrt-pada-3' WHEN 'sloka' THEN CASE WHEN wrong = 0 THEN least('anustubh-sloka', g.fixed) ELSE coalesce(g.fixed, 'anustubh-sloka') END ELSE m.id END AS primary_id,
CASE layout WHEN 'one line' THEN CASE WHEN m.id IS NOT NULL THEN 0 END WHEN 'sloka' THEN CASE WHEN g.fixed IS NULL THEN wrong ELSE 0 END ELSE 0 END::BIGINT AS distance FROM c LEFT JOIN o USING (conv_id, turn, layout, k) LEFT JOIN g USING (conv_id, turn, layout, k) LEFT JOIN m USING (conv_id, turn, layout, k)""")
def turn_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every turn's syllables laid out as Vedic stanzas, ślokas and single lines."""
    turns, laid = _turns(spark, sf_dir), []
    for name, sizes, tradition in _LAYOUTS:
        verses = F.transform(F.regexp_extract_all("p", F.lit(f"(.{{{sum(sizes)}}})"), F.lit(1)), lambda x: F.array(*[F.substring(x, sum(sizes[:i]) + 1, size) for i, size in enumerate(sizes)]))  # noqa: B023  called at once
        laid.append(F.struct(F.lit(name).alias("layout"), F.lit(tradition).alias("asked"), verses.alias("verses")))
    rows = turns.select("conv_id", "turn", F.inline_outer(F.array(*laid))).select("conv_id", "turn", "layout", "asked", F.posexplode_outer("verses").alias("k", "units"))
    found = M.verdicts(rows.where("units is not null"))
    return found.select("conv_id", "turn", "layout", F.col("k").cast("long").alias("k"), "status", "primary_id", F.col("distance").cast("long").alias("distance"))


@query("""WITH b AS (SELECT n_name, lower(n_name) AS k, 'w' || n_nationkey || '.wav' AS wav FROM nation), r AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) WHEN 2 THEN upper('w' || n_nationkey) WHEN 3 THEN 'none' END AS meter FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, meter, coalesce(b.wav, c.wav, (SELECT wav FROM b WHERE k = 'france')) AS wav FROM r LEFT JOIN b ON lower(meter) = b.k LEFT JOIN b c ON lower(meter) || '.wav' = c.wav""")
def supplier_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording for each supplier by its nation's name or its recording's own stem, case ignored, France's for the rest."""
    nation = table(spark, sf_dir, "nation")
    wav = F.concat(F.lit("w"), F.col("n_nationkey").cast("string"))
    bank = nation.select(F.col("n_name").alias("meter"), F.concat(wav, F.lit(".wav")).alias("wav"))
    kind = F.col("s_suppkey") % 5
    name = F.when(kind == 0, F.col("n_name")).when(kind == 1, F.lower("n_name")).when(kind == 2, F.upper(wav)).when(kind == 3, "none")
    rows = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", name.alias("meter"))
    return V.bank_lookup(rows, bank, "meter", "france").select("s_suppkey", "meter", "wav")


_SAMA = values([(r[0], r[1], len(r[5][0]), r[5][0][:-1]) for r in dims.meter_rows() if r[3] == "sama-vrtta"], "ord, id, size, stem")


@query(f"""WITH t AS (SELECT conv_id, turn, array_to_string({LG}, '') AS p FROM conversations),
c AS (SELECT conv_id, turn, n, m, unnest(range(len(p) // n)) AS k, p FROM t, (VALUES (22, 11), (21, 7)) AS l(n, m)),
v AS (SELECT conv_id, turn, n, m, k, p[k * n + 1:k * n + n] AS x FROM c),
e AS (SELECT v.*, s.id, s.size, s.ord FROM v JOIN {_SAMA.replace(') AS t(', ') AS s(')} ON n % s.size = 0 AND n // s.size <= 4 AND len(list_filter(range(n // s.size), lambda i: x[i * s.size + 1:i * s.size + s.size - 1] <> s.stem)) = 0),
a AS (SELECT conv_id, turn, n, k, arg_min(id, (-size, ord)) AS id, max(size) AS size FROM e GROUP BY ALL),
d AS (SELECT conv_id, turn, n, k, min(id) AS id, count(*) AS tied FROM (SELECT conv_id, turn, n, k, x[1:10] AS p1, x[12:21] AS p2 FROM v WHERE n = 22) JOIN {_KNOWN} ON p1 = a AND p2 = b AND p1 = c AND p2 = d GROUP BY ALL
    UNION ALL SELECT conv_id, turn, n, k, '{_MIXED[0]}', 1 FROM v WHERE n = 22 AND list_sort([x[1:10], x[12:21]]) = list_sort({_SIBLINGS})),
w AS (SELECT conv_id, turn, n, k, min(id) AS id, sum(tied) AS tied FROM d GROUP BY ALL),
o AS (SELECT conv_id, turn, n, k, arg_min(s.id, ord) AS id FROM v JOIN {_SAMA.replace(') AS t(', ') AS s(')} ON n = 21 AND s.size = 7 AND x[1:6] = s.stem GROUP BY ALL)
SELECT v.conv_id, v.turn, v.n, CAST(v.k AS BIGINT) AS k, CASE WHEN a.id IS NOT NULL THEN 'exact' WHEN v.n = 22 THEN 'doubled' WHEN o.id IS NOT NULL THEN 'first-exact' END AS strategy, coalesce(a.id, CASE WHEN v.n = 22 THEN coalesce(w.id, 'vedic-tristubh') ELSE o.id END) AS meter_id,
CASE WHEN a.id IS NOT NULL THEN 'exact' WHEN v.n = 22 THEN CASE WHEN w.tied > 1 THEN 'ambiguous' WHEN w.id IN {dims.DUAL_AUTHORITY} THEN 'identified' ELSE 'provisional' END WHEN o.id IS NOT NULL THEN 'exact' END AS status, CASE WHEN a.id IS NOT NULL THEN a.size WHEN v.n = 21 AND o.id IS NOT NULL THEN 7 END AS syllables
FROM v LEFT JOIN a USING (conv_id, turn, n, k) LEFT JOIN w USING (conv_id, turn, n, k) LEFT JOIN o USING (conv_id, turn, n, k)""")
def turn_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A meter for every two lines of eleven and every three of seven of every turn, by the first reading that holds."""
    cut = lambda x, n: F.regexp_extract_all(x, F.lit(f"(.{{{n}}})"), F.lit(1))
    laid = F.array(*[F.struct(F.lit(n).alias("n"), cut("p", n).alias("verses")) for n in (22, 21)])
    rows = _turns(spark, sf_dir).select("conv_id", "turn", F.inline_outer(laid)).select("conv_id", "turn", "n", F.posexplode_outer("verses").alias("k", "x")).where("x is not null")
    lines = F.when(F.col("n") == 22, cut("x", 11)).otherwise(cut("x", 7))
    parts = rows.select(F.struct("conv_id", "turn", "n", "k").alias("verse_id"), lines.alias("lines"))
    found = A.identified(parts)
    return found.select("verse_id.conv_id", "verse_id.turn", "verse_id.n", F.col("verse_id.k").cast("long").alias("k"), "strategy", "meter_id", "status", "syllables")
