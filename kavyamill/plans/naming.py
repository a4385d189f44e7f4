"""Queries on names: recordings for meters' names made from the documents' words, and words within words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kavyamill.operators import naming as N
from kavyamill.plans.registry import query, table, values

_KEYS = [k for k, _ in (*N.RECORDED, *N.SURROGATES)]
#: A name for each document: null, a key as it is, in capitals with blanks, within a word, before another key, after the
#: name of the mixed family, a word without a key, or blanks. In both languages alike.
_NAME = """CASE doc_id % 8 WHEN 0 THEN NULL WHEN 1 THEN k1 WHEN 2 THEN concat(' ', upper(k1), ' ') WHEN 3 THEN concat(word, k1, word)
    WHEN 4 THEN concat(k1, word, k2) WHEN 5 THEN concat('Upajāti ', word, k2) WHEN 6 THEN word ELSE '  ' END"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array(*map(F.lit, _KEYS))
    at = lambda i: F.get(keys, (i % len(_KEYS)).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 25).alias("syllables"), F.regexp_extract("text", "[A-Za-z]+", 0).alias("word"), at(F.col("doc_id")).alias("k1"), at(F.floor(F.col("doc_id") / 7)).alias("k2"))
    return docs.select("doc_id", F.expr(_NAME).alias("name"), "syllables")


_COUNTS = " ".join(f"WHEN syllables = {n} THEN '{v}'" for n, v, _ in N.BY_COUNT)
_TWELVE = " OR ".join(f"contains(p, '{x}')" for x in N.MIXED_OF_TWELVE)


@query(f"""WITH d AS (SELECT doc_id, n_chars % 25 AS syllables, regexp_extract(text, '[A-Za-z]+') AS word, k[doc_id % {len(_KEYS)} + 1] AS k1, k[doc_id // 7 % {len(_KEYS)} + 1] AS k2 FROM documents, (SELECT {_KEYS} AS k)),
n AS (SELECT doc_id, syllables, {_NAME} AS name FROM d), q AS (SELECT *, trim(lower(name)) AS p FROM n),
a AS (SELECT * FROM {values([(i, *x) for i, x in enumerate(N.RECORDED)], 'i, key, value')}), b AS (SELECT * FROM {values([(i, *x) for i, x in enumerate(N.SURROGATES)], 'i, key, value')}),
ia AS (SELECT p, arg_min(value, i) AS value FROM (SELECT DISTINCT p FROM q) JOIN a ON contains(p, key) GROUP BY p), ib AS (SELECT p, arg_min(value, i) AS value FROM (SELECT DISTINCT p FROM q) JOIN b ON contains(p, key) GROUP BY p),
t AS (SELECT doc_id, name, syllables, a.value AS av, b.value AS bv, ia.value AS iav, ib.value AS ibv, CASE WHEN starts_with(p, 'upajāti') OR starts_with(p, 'upajati') THEN 'mixed' WHEN a.value IS NOT NULL THEN 'name' WHEN b.value IS NOT NULL THEN 'surrogate' WHEN ia.value IS NOT NULL THEN 'within' WHEN ib.value IS NOT NULL THEN 'surrogate-within' WHEN syllables IN (8, 11, 12, 14, 15, 17, 19, 21) THEN 'count' ELSE 'default' END AS tier, {_TWELVE} OR syllables = 12 AS twelve FROM q LEFT JOIN a ON p = a.key LEFT JOIN b ON p = b.key LEFT JOIN ia USING (p) LEFT JOIN ib USING (p))
SELECT doc_id, name, CASE tier WHEN 'mixed' THEN CASE WHEN twelve THEN 'vaṃśastha' ELSE 'upajāti' END WHEN 'name' THEN av WHEN 'surrogate' THEN bv WHEN 'within' THEN iav WHEN 'surrogate-within' THEN ibv WHEN 'count' THEN CASE {_COUNTS} END ELSE 'vasantatilakā' END AS bank_key, tier IN ('surrogate', 'surrogate-within', 'default') OR tier = 'count' AND syllables = 17 AS is_surrogate, tier FROM t""")
def bank_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recording for each document's name: by the name, by what stands in, by the first key in it, by its count."""
    return N.recordings(_names(spark, sf_dir), "name", "syllables").select("doc_id", "name", "bank_key", "is_surrogate", "tier")


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM documents),
b AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS key FROM benchmark), k AS (SELECT key, CAST(min(item_id) AS BIGINT) AS rank FROM b WHERE length(key) >= 5 GROUP BY key)
SELECT name, arg_min(key, (rank, key)) AS key, min(rank) AS rank FROM w JOIN k ON contains(name, key) GROUP BY name""")
def words_within_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of the documents with the first benchmark word of five letters or more, by item, that it contains."""
    of = lambda name, *more: table(spark, sf_dir, name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("key"), *more)
    keys = of("benchmark", F.col("item_id").alias("rank")).where("length(key) >= 5")
    return N.first_contained(of("documents").withColumnRenamed("key", "name"), keys).select("name", "key", "rank")
