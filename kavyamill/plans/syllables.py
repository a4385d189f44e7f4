"""Queries on syllable tables with spans, and on the second reading that judges them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kavyamill.functions import prosody as P
from kavyamill.operators import syllables as S
from kavyamill.plans.registry import query, table, words

_V, _LONG = P.VOWELS, P.LONG
_PAIRS = "lower(p)"
for _pair, _one in P.IAST_PAIRS:
    _PAIRS = f"replace({_PAIRS}, '{_pair}', '{_one}')"
_QUIET = "[\\s''’‘“”`,;.!?\"()|‐‑–—-]"
#: In DuckDB: pādas of a line as sounds, their faults, and weights of their syllables.
_LINES = f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
p AS (SELECT doc_id, line, regexp_replace(regexp_replace(p, '^[\\s|]+', ''), '([|]\\s*[0-9]+)?[\\s|]*$', '') AS p FROM (SELECT doc_id, line, unnest(CASE WHEN contains(text, '|') THEN string_split_regex(text, '[|]+') ELSE [text] END) AS p FROM l)),
s AS (SELECT doc_id, line, p, translate(regexp_replace({_PAIRS}, '{_QUIET}', '', 'g'), '{P.IAST_FROM}', '{P.IAST_TO}') AS s FROM p WHERE NOT regexp_matches(p, '^[0-9]*$')),
f AS (SELECT doc_id, line, s, CASE WHEN regexp_matches(lower(p), '[fqwxz]') OR translate(s, '{P.ALPHABET}3', '') <> '' OR regexp_matches(s, '^3') AND s = '3' THEN 'unknown-character' WHEN NOT regexp_matches(s, '[{_V}]') THEN 'no-vowel' WHEN regexp_matches(s, '(^|[^{_V}])[3MH]') THEN 'misplaced-mark' END AS unread FROM s),
w AS (SELECT *, CASE WHEN unread IS NULL THEN regexp_extract_all(s, '[{_V}][^{_V}]*') ELSE [] END AS tokens FROM f),
m AS (SELECT doc_id, line, unread, list_transform(tokens, lambda x, i: CASE WHEN contains(x, '3') THEN 3 WHEN contains('{_LONG}', x[1]) OR regexp_matches(x, '[MH]') OR len(x) > 2 OR (i = len(tokens) AND len(x) > 1) THEN 2 ELSE 1 END) AS matras FROM w)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return docs.select(F.struct("doc_id", "line").alias("verse_id"), "text")


@query(f"""WITH {_LINES},
t AS (SELECT doc_id, line, count(*) AS padas, list_sort(list_distinct(list(unread) FILTER (WHERE unread IS NOT NULL))) AS unread, flatten(list(matras)) AS m FROM m GROUP BY doc_id, line),
e AS (SELECT l.doc_id, l.line, coalesce(padas, 0) AS padas, coalesce(m, []) AS m, list_concat(CASE WHEN NOT regexp_matches(text, '\\p{{Latin}}') THEN ['no-letters'] WHEN regexp_matches(lower(text), 'aa|ii|uu|chh|sh|\\.r|r\\^i|~n') THEN ['ascii-scheme'] ELSE [] END, coalesce(unread, [])) AS errors FROM l LEFT JOIN t USING (doc_id, line))
SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(padas AS BIGINT) AS padas, CAST(len(m) AS BIGINT) AS syllables, CAST(len(list_filter(m, lambda x: x > 1)) AS BIGINT) AS guru, CAST(coalesce(list_sum(m), 0) AS BIGINT) AS matras, array_to_string(errors, ' ') AS errors, CASE WHEN len(errors) > 0 OR len(m) = 0 THEN 'not-run' ELSE 'verified' END AS status FROM e""")
def verified_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis of every line of every document as a verse, ok only where the second reading agrees."""
    found = S.verified(_lines(spark, sf_dir))
    return found.select("verse_id.doc_id", F.col("verse_id.line").cast("long").alias("line"), "padas", "syllables", "guru", "matras", F.array_join("errors", " ").alias("errors"), "status")


#: Forged fields of a word's first syllable, what they become, and the codes that must be found.
FORGED = [
    ("index", lambda x: x + 1, "INDEX_MISMATCH"), ("pada_index", lambda x: x + 1, "PADA_INDEX_MISMATCH"), ("position", lambda x: x + 1, "POSITION_MISMATCH"), ("iast", lambda x: F.concat(x, F.lit("x")), "TEXT_MISMATCH"),
    ("onset", lambda x: F.concat(x, F.lit("x")), "PARTS_MISMATCH"), ("weight", lambda x: F.when(x == "guru", "laghu").otherwise("guru"), "WEIGHT_MISMATCH"), ("matras", lambda x: x + 3, "MATRAS_MISMATCH"), ("rule", lambda x: F.lit("forged"), "RULE_MISMATCH"),
    ("reason", lambda x: F.lit("forged"), "REASON_MISMATCH"), ("anceps", lambda x: ~x, "ANCEPS_MISMATCH"), ("pluta", lambda x: ~x, "PLUTA_MISMATCH"), ("next_iast", lambda x: F.concat(x, F.lit("x")), "CONTEXT_MISMATCH"), ("pada_final", lambda x: ~x, "FINAL_CONTEXT_MISMATCH"),
    ("deva", lambda x: F.lit("forged"), "DEVA_MISMATCH"), ("text", lambda x: F.lit("forged"), "DISPLAY_MISMATCH"), ("end", lambda x: x - x, "SPAN_BOUNDS_INVALID"), ("source", lambda x: F.lit("forged"), "SOURCE_MISMATCH"), ("column", lambda x: x + 1, "SPAN_LOCATION_MISMATCH"),
]
#: Beyond these a word's pattern, its mātrās or its last syllable are forged, its number is, or nothing.
_WHOLE = {"pattern": "PATTERN_MISMATCH", "matras": "PADA_MATRAS_MISMATCH", "syllables": "PADA_COUNT_MISMATCH", "pada_index": "PADA_ORDER_MISMATCH PADA_INDEX_MISMATCH"}
_KINDS = len(FORGED) + len(_WHOLE) + 1
_KIND = f"(length(word) * 7 + ascii(word) + ascii(reverse(word)) * 3) % {_KINDS}"
_CODES = " ".join(f"WHEN {k} THEN '{codes}'" for k, codes in enumerate([c for _, _, c in FORGED] + list(_WHOLE.values())))


@query(f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
k AS (SELECT word, {_KIND} AS kind FROM w WHERE regexp_matches(word, '[aeiou]') AND NOT regexp_matches(word, '[fqwxz]')),
c AS (SELECT word, kind, unnest(string_split(CASE kind {_CODES} ELSE '' END, ' ')) AS code FROM k)
SELECT word, code, CAST(CASE WHEN kind < {len(FORGED)} OR code = 'PADA_INDEX_MISMATCH' THEN 0 END AS BIGINT) AS position FROM c WHERE code <> '' AND NOT (kind = {len(FORGED) + 3} AND code = 'PADA_INDEX_MISMATCH')
UNION ALL SELECT word, 'PADA_INDEX_MISMATCH', unnest(range(len(regexp_extract_all(word, 'ai|au|[aeiou]')))) FROM k WHERE kind = {len(FORGED) + 3}""")
def forged_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second reading says of every readable word of the documents after one thing in its analysis was forged."""
    rows = S.analyses(words(spark, sf_dir).select(F.col("word").alias("verse_id"), F.col("word").alias("text")), spelled=False).where("unread is null")
    kind = F.expr(_KIND.replace("word", "verse_id"))

    def change(x, i):
        out = x
        for k, (field, forge, _) in enumerate(FORGED):
            out = out.withField(field, F.when((i == 0) & (F.col("kind") == k), forge(x[field])).otherwise(x[field]))
        return out

    at = {name: len(FORGED) + k for k, name in enumerate(_WHOLE)}
    forged = rows.withColumn("kind", kind).withColumn("syllables", F.transform("syllables", change))
    forged = forged.withColumns({
        "pattern": F.when(F.col("kind") == at["pattern"], F.concat("pattern", F.lit("G"))).otherwise(F.col("pattern")),
        "matras": F.when(F.col("kind") == at["matras"], F.col("matras") + 1).otherwise(F.col("matras")),
        "syllables": F.when(F.col("kind") == at["syllables"], F.concat("syllables", F.slice("syllables", 1, 1))).otherwise(F.col("syllables")),
        "pada_index": F.when(F.col("kind") == at["pada_index"], F.col("pada_index") + 1).otherwise(F.col("pada_index")),
    })
    return S.recheck(forged).select(F.col("verse_id").alias("word"), "code", F.col("position").cast("long").alias("position"))


@query("""WITH w AS (SELECT item_id, text, generate_subscripts(string_split(text, ' '), 1) AS i, unnest(string_split(text, ' ')) AS word FROM benchmark),
o AS (SELECT item_id, text, word, CAST(coalesce(sum(length(word) + 1) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM w)
SELECT item_id, start, word, length(left(text, start)) - length(replace(left(text, start), chr(10), '')) + 1 AS line, start - length(regexp_extract(left(text, start), '(?s)^(.*\\n)')) + 1 AS col FROM o""")
def word_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and column of every word of every benchmark item, from its offset."""
    from kavyamill.operators.verse import line_column

    items = table(spark, sf_dir, "benchmark").select("item_id", "text", F.split("text", " ").alias("words"))
    placed = items.withColumn("size", F.transform("words", lambda w: F.char_length(w) + 1)).withColumn("ends", P.prefix_sums(F.col("size")))
    rows = placed.select("item_id", "text", F.explode(F.zip_with("words", "ends", lambda w, e: F.struct(w.alias("word"), (e - 1 - F.char_length(w)).alias("start")))).alias("x"))
    at = line_column(F.col("text"), F.col("x.start"))
    return rows.select("item_id", F.col("x.start").cast("long").alias("start"), "x.word", at["line"].cast("long").alias("line"), at["column"].cast("long").alias("col"))
