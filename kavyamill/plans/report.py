"""Queries on reports of meters: worked verses, forged reports, stanzas and single syllables of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kavyamill import dims
from kavyamill.functions import akshara as A
from kavyamill.functions import prosody as P
from kavyamill.operators import checks as K
from kavyamill.operators import meter as M
from kavyamill.operators import report as R
from kavyamill.plans.meter import VERDICTS, VERSES, catalog_units, units
from kavyamill.plans.prosody import LG
from kavyamill.plans.registry import golden, query, table, values, words

#: Worked reports: verse, label, observed pādas, subtypes, notes, template, feet.
REPORTS = [
    ("bg-15-15", "indravajrā (triṣṭubh — 11 akṣara)", "GGLGGLLGLGG GGLGGLLGLGL GGLGGLLGLGG GGLGGLLGLGG", "", "final-licence-2", "——◡ ——◡ ◡—◡ ——*", "ta · ta · ja · G · G"),
    ("bg-2-47", "anuṣṭubh (śloka) — 8 akṣara — provisional", "GGGGLGGG GLGLLGLL GGLLLGGG GGGGLGLL", "pathyā, even-pāda cadence, pathyā, even-pāda cadence", "", None, None),
    ("sankhya-1", "āryā — provisional", "GGLGLGG GGGLLLGLGGG GGGGGG GGGGLGGG", "", "", None, None),
    ("gayatri", "gāyatrī nicrt pada 1 — provisional", "GLLGLGG GGGGLGLL LGGGLGLG", "", "", None, None),
    ("meghaduta-1", "mandākrāntā (atyaṣṭi — 17 akṣara) — provisional", "GGGGLLLLLGGLGGLGG GGGGLLLLLGGLGGLGG GGGGLLLLLGGLGGLGG GGGGLLLLLGGLGGLGL", "", "final-licence-4", "——— — ‖ ◡◡◡ ◡◡— ‖ —◡— —◡— —*", "ma · bha · na · ta · ta · G · G"),
    ("mixed-siblings", "upajāti (indravajrā–upendravajrā) (triṣṭubh — 11 akṣara)", "GGLGGLLGLGG GGLGGLLGLGG LGLGGLLGLGG GGLGGLLGLGG", "indravajrā, indravajrā, upendravajrā, indravajrā", "", None, None),
    ("one-pada", "mandākrāntā (atyaṣṭi — 17 akṣara) — fragment only", "GGGGLLLLLGGLGGLGG", "", "", "——— — ‖ ◡◡◡ ◡◡— ‖ —◡— —◡— —*", "ma · bha · na · ta · ta · G · G"),
    ("nothing", "unidentified metre", None, None, None, None, None),
]


def _worked(spark: SparkSession) -> DataFrame:
    asked = spark.createDataFrame([(x[0], x[1]) for x in VERDICTS], "verse_id string, asked string")
    return units(spark).join(F.broadcast(asked), "verse_id")


@golden(f"SELECT * FROM {values(REPORTS, 'verse_id, label, observed, subtypes, notes, template, gana_formula')}")
def meter_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = R.report(_worked(spark)).where(F.col("verse_id").isin(*[x[0] for x in REPORTS]))
    first = F.get("candidates", F.lit(0))
    shown = reports.select("verse_id", F.array_join(first["observed"], " ").alias("observed"), F.array_join(first["notes"], ", ").alias("notes"))
    joined = R.summary(reports).select("verse_id", "label", F.array_join("subtypes", ", ").alias("subtypes"), "template", "gana_formula")
    return joined.join(shown, "verse_id").select("verse_id", "label", "observed", "subtypes", "notes", "template", "gana_formula")


#: Forgeries: name, verse, what the reports' columns become, what the first candidate's fields become, codes to be found.
FORGERIES = [
    ("promoted", "meghaduta-1", {"status": "identified", "identified": True}, {}, ["IDENTIFIED_FLAG_MISMATCH", "STATUS_MISMATCH"]),
    ("other-weights", "bg-2-47", {}, {"observed": ["GGGGGGGG", "GLGLLGLL", "GGLLLGGG", "GGGGLGLL"]}, ["OBSERVED_PATTERN_CHANGED"]),
    ("other-target", "bg-15-15", {}, {"expected": ["LGLGGLLGLGG", "GGLGGLLGLGG", "GGLGGLLGLGG", "GGLGGLLGLGG"]}, ["FIXED_TARGET_CHANGED"]),
    ("fragment-as-whole", "one-pada", {"status": "provisional"}, {"match_type": "exact", "evidence": "full-verse"}, ["FIXED_EVIDENCE_MISMATCH", "MATCH_TYPE_MISMATCH"]),
    ("display", "bg-15-15", {}, {"notes": ["forged"], "yati": [5], "template": "forged", "subtypes": ["forged"], "name": "forged"}, ["FIXED_NOTES_CHANGED", "FIXED_SUBTYPES_CHANGED", "NAME_CHANGED", "TEMPLATE_CHANGED", "YATI_CHANGED"]),
    ("other-first", "alternating-siblings", {"primary_id": "upajati-tristubh"}, {}, ["PRIMARY_MISMATCH"]),
    ("near-as-exact", "one-wrong", {"status": "provisional"}, {"match_type": "exact", "distance": 0}, ["DISTANCE_MISMATCH", "MATCH_TYPE_MISMATCH"]),
    ("other-lines", "gayatri", {"unit_patterns": ["GLLGLGG", "GGGGLGLL"]}, {}, ["UNIT_PATTERNS_CHANGED"]),
    ("other-members", "mixed-siblings", {}, {"subtypes": ["indravajrā"] * 4}, ["UPAJATI_SUBTYPES_CHANGED"]),
    ("unknown", "sankhya-1", {}, {"id": "forged"}, ["EXPECTED_CANDIDATE_OMITTED", "MATCH_TYPE_MISMATCH", "PRIMARY_MISMATCH", "UNKNOWN_CANDIDATE"]),
    *[(f"dropped-{v}", v, {"status": "unidentified", "identified": False, "primary_id": None, "candidates": None}, {}, ["EXPECTED_CANDIDATE_OMITTED"] * (2 if v == "alternating-siblings" else 1)) for v in ("bg-15-15", "bg-2-47", "sankhya-1", "gayatri", "alternating-siblings", "one-pada")],
]


def _forged(reports: DataFrame) -> DataFrame:
    """Reports named by the forgery in `verse_id`, each with its own changes."""
    kind = reports.schema["candidates"].dataType
    literal = lambda x: F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x)

    def change(c, i):
        out = c
        for field in sorted({f for x in FORGERIES for f in x[3]}):
            value = c[field]
            for name, _, _, first, _ in FORGERIES:
                if field in first:
                    value = F.when(F.col("verse_id") == name, literal(first[field]).cast(kind.elementType[field].dataType)).otherwise(value)
            out = out.withField(field, value)
        return F.when(i == 0, out).otherwise(c)

    changed = {"candidates": F.transform("candidates", change)}
    for name, _, whole, _, _ in FORGERIES:
        for column, x in whole.items():
            value = F.array().cast(kind) if column == "candidates" else literal(x).cast(reports.schema[column].dataType)
            changed[column] = F.when(F.col("verse_id") == name, value).otherwise(changed.get(column, F.col(column)))
    return reports.withColumns(changed)


@golden(f"SELECT * FROM {values([(name, code) for name, _, _, _, codes in FORGERIES for code in codes], 'verse_id, code')}")
def meter_forgeries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checker says of reports in which something was changed: each forgery is a verse of its own."""
    names = F.broadcast(spark.createDataFrame([(x[1], x[0]) for x in FORGERIES], "verse_id string, forgery string"))
    lines = _worked(spark).join(names, "verse_id").withColumn("verse_id", F.col("forgery")).drop("forgery")
    return K.check(lines, _forged(R.report(lines))).select("verse_id", "code")


@golden("SELECT CAST(NULL AS VARCHAR) AS verse_id, CAST(NULL AS VARCHAR) AS code, CAST(NULL AS VARCHAR) AS id WHERE false")
def meter_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checker says of true reports on all meters of the catalog and the worked verses: nothing.

    meter_forgeries shows that it does speak.
    """
    lines = _worked(spark).unionByName(catalog_units(spark).withColumn("asked", F.lit("auto")))
    return K.check(lines, R.report(lines))


_ELEVENS = values([(r[1], *(p[:10] for p in r[6])) for r in dims.meter_rows() if all(len(p) == 11 for p in r[6])], "id, a, b, c, d")
_SIBLINGS = tuple(next(r[5][0][:10] for r in dims.meter_rows() if r[1] == x) for x in dims.UPAJATI[0][2:])
_STANZAS = f"SELECT doc_id, s, array_to_string(w[s * 44 + 1:s * 44 + 11], '') AS p1, array_to_string(w[s * 44 + 12:s * 44 + 22], '') AS p2, array_to_string(w[s * 44 + 23:s * 44 + 33], '') AS p3, array_to_string(w[s * 44 + 34:s * 44 + 44], '') AS p4 FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) // 44 - 1)) AS s FROM (SELECT doc_id, {LG} AS w FROM documents))"


@query(f"""WITH s AS ({_STANZAS}),
d AS (SELECT doc_id, s, id, hamming(left(p1, 10), a) + hamming(left(p2, 10), b) + hamming(left(p3, 10), c) + hamming(left(p4, 10), d) AS distance FROM s CROSS JOIN {_ELEVENS}
UNION ALL SELECT doc_id, s, '{dims.UPAJATI[0][0]}', 0 FROM s WHERE list_sort(list_distinct([left(p1, 10), left(p2, 10), left(p3, 10), left(p4, 10)])) = list_sort(['{_SIBLINGS[0]}', '{_SIBLINGS[1]}'])),
b AS (SELECT doc_id, s, min(distance) AS distance, arg_min(id, (distance, id)) AS primary_id, count(*) FILTER (WHERE distance = 0) AS exact FROM d GROUP BY doc_id, s)
SELECT doc_id, CAST(s AS BIGINT) AS stanza, CASE WHEN exact = 0 THEN 'unidentified' WHEN exact > 1 THEN 'ambiguous' WHEN primary_id IN {dims.DUAL_AUTHORITY} THEN 'identified' ELSE 'provisional' END AS status, primary_id, CAST(distance AS BIGINT) AS distance FROM b""")
def document_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every stanza of every document: 44 syllables read as four lines of eleven, in the classical tradition.

    The oracle leaves out the mātrā meters, for which the four lines would have to last 12, 18 or 20, 12, and 15, 18 or 20.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", P.pattern(P.letters(F.col("text"))).alias("p"))
    stanzas = docs.select("doc_id", F.posexplode_outer(F.regexp_extract_all("p", F.lit("(.{44})"), F.lit(1))).alias("stanza", "p")).where("p is not null")
    found = M.four_lines(stanzas, "p", 11)
    return found.select("doc_id", F.col("stanza").cast("long").alias("stanza"), "status", "primary_id", F.col("distance").cast("long").alias("distance"))


#: Judged syllables: text, what follows, reason, weight, mātrās, rule, whether what follows would decide.
SYLLABLES = [
    ("rā", None, None, "guru", 2, "dirgha-guru", False), ("ra", None, None, "laghu", 1, "hrasva-laghu", True), ("ra", "ma", None, "laghu", 1, "hrasva-laghu", False), ("ra", "", None, "laghu", 1, "hrasva-laghu", False),
    ("ra", " kṣa", None, "guru", 2, "position-guru", False), ("ra", "| kṣa", None, "laghu", 1, "hrasva-laghu", False), ("ra", "kha", None, "laghu", 1, "hrasva-laghu", False), ("raṃ", None, None, "guru", 2, "mark-guru", False),
    ("tat", None, None, "guru", 2, "closed-guru", False), ("strai", None, None, "guru", 2, "dirgha-guru", False), ("ā3", None, None, "guru", 3, "pluta-guru", False), ("a3ṃ", None, None, "guru", 3, "pluta-guru", False),
    ("तत्", None, None, "guru", 2, "closed-guru", False), ("क", "क्ष", None, "guru", 2, "position-guru", False), ("क", None, None, "laghu", 1, "hrasva-laghu", True), ("कः", None, None, "guru", 2, "mark-guru", False), ("क३", None, None, "guru", 3, "pluta-guru", False),
    ("", None, "empty", None, None, None, None), ("ra ma", None, "break", None, None, None, None), ("rकa", None, "mixed-script", None, None, None, None), ("a3a3", None, "several-plutas", None, None, None, None), ("ra2", None, "unknown-character", None, None, None, None),
    ("qa", None, "unknown-character", None, None, None, None), ("ṃ", None, "mark-alone", None, None, None, None), ("k", None, "no-vowel", None, None, None, None), ("rama", None, "several-vowels", None, None, None, None), ("kṃa", None, "mark-first", None, None, None, None), ("atṃ", None, "mark-apart", None, None, None, None), ("at3", None, "pluta-apart", None, None, None, None),
]


@golden(f"SELECT * FROM {values(SYLLABLES, 'text, following, reason, weight, matras, rule, position_sensitive')}")
def akshara_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([x[:2] for x in SYLLABLES], "text string, following string").withColumn("j", A.judge(F.col("text"), F.col("following")))
    return rows.select("text", "following", *[f"j.{x}" for x in ("reason", "weight", "matras", "rule", "position_sensitive")])


_SOUND = "kh|gh|ch|jh|th|dh|ph|bh|[kgcjtdnpbmyrlvsh]"


@query(f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
v AS (SELECT word, len(regexp_extract_all(word, 'ai|au|[aeiou]')) AS n FROM w)
SELECT word, CASE WHEN regexp_matches(word, '[fqwxz]') THEN 'unknown-character' WHEN n = 0 THEN 'no-vowel' WHEN n > 1 THEN 'several-vowels' END AS reason,
CASE WHEN n = 1 AND NOT regexp_matches(word, '[fqwxz]') THEN CASE WHEN regexp_matches(word, 'ai|au|[eo]') THEN 'dirgha-guru' WHEN regexp_matches(word, '({_SOUND})$') THEN 'closed-guru' ELSE 'hrasva-laghu' END END AS rule FROM v""")
def akshara_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word in ASCII letters of every document, judged as one syllable."""
    return words(spark, sf_dir).withColumn("j", A.judge(F.col("word"))).select("word", "j.reason", "j.rule")
