"""Queries that work in rounds and in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kavyamill.operators import corpus as C
from kavyamill.operators import rounds as R
from kavyamill.operators import syllables as S
from kavyamill.plans.registry import query, table
from kavyamill.plans.scripts import _WEIGHTS, _WORDS, _words

_HREFS = "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a href=\"(/[^\"]{{6,}})\"', 1)) AS href FROM pages".replace("{{", "{").replace("}}", "}")


@query(f"""WITH RECURSIVE h AS ({_HREFS}), e AS (SELECT 'page ' || page_id AS a, href AS b FROM h UNION SELECT href, 'page ' || page_id FROM h),
r AS (SELECT 'page ' || page_id AS node, 0 AS depth FROM pages WHERE page_id % 50 = 0 UNION SELECT b, depth + 1 FROM r JOIN e ON a = node WHERE depth < 30)
SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def crawled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages and links that every fiftieth page leads to, over links and the pages that share them, and how far they are."""
    found = F.regexp_extract_all("html", F.lit('<a href="(/[^"]{6,})"'), F.lit(1))
    held = table(spark, sf_dir, "pages").select(F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("source"), F.explode(found).alias("target")).distinct()
    both = held.unionByName(held.select(F.col("target").alias("source"), F.col("source").alias("target")))
    seeds = table(spark, sf_dir, "pages").where("page_id % 50 = 0").select(F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("node"))
    return R.crawl(both, seeds)


_LOUD = "((7000 + event_id * 131 + {0} * 17) * 2654435761 % 1000 + value)"


@query(f"""WITH s AS (SELECT event_id, k, {_LOUD.format('k')} AS loud FROM events, range(4) t(k)), p AS (SELECT event_id, min(k) FILTER (WHERE loud > 700) AS k FROM s GROUP BY event_id)
SELECT s.event_id, CAST(s.k + 1 AS INTEGER) AS attempts, round(loud, 4) AS loud, p.k IS NOT NULL AS passed FROM s JOIN p ON s.event_id = p.event_id AND s.k = coalesce(p.k, 3)""")
def retried_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event tried with new seeds until its score passes, four times at most."""

    def attempt(rows: DataFrame, k: int) -> DataFrame:
        loud = F.expr(_LOUD.format(k))
        return rows.withColumn("loud", F.round(loud, 4)).withColumn("passed", loud > 700)

    return R.retried(table(spark, sf_dir, "events").select("event_id", "value"), attempt).select("event_id", "attempts", "loud", "passed")


@query("""WITH b AS (SELECT doc_id, strlen(text) + 1 AS size, coalesce(sum(strlen(text) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT CAST(before // 100000 AS BIGINT) AS file, CAST(count(*) AS BIGINT) AS n, CAST(sum(size) AS BIGINT) AS bytes, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM b GROUP BY before // 100000""")
def rotated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in order in files of about 100,000 bytes: what each file holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("size"))
    numbered = R.file_numbers(docs, ["doc_id"], F.col("size") + 1, 100_000)
    return numbered.groupBy("file").agg(F.count("*").alias("n"), F.sum(F.col("size") + 1).cast("long").alias("bytes"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


_SPREAD = "SELECT doc_id, {0} AS list FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents WHERE {1}) WHERE n <= {2} OR r IN (SELECT i * (n - 1) // {3} FROM range({2}) t(i))"
_STRATA = (("lang = 'en'", 10), ("lang IN ('fr', 'de')", 5), ("n_chars > 2000", 15))


@query("WITH p AS (" + " UNION ALL ".join(_SPREAD.format(i, where, k, k - 1) for i, (where, k) in enumerate(_STRATA)) + "), f AS (SELECT doc_id, min(list) AS list FROM p GROUP BY doc_id) SELECT doc_id, list, CAST(row_number() OVER (ORDER BY list, doc_id) - 1 AS BIGINT) AS place FROM f ORDER BY list, doc_id LIMIT 28")
def pilot_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten, five and fifteen documents evenly spread over three strata that overlap, the first list's first, 28 at most."""
    docs = table(spark, sf_dir, "documents")
    picks = [C.systematic_sample(docs.where(where).select("doc_id"), "doc_id", k).withColumn("at", F.col("doc_id")) for where, k in _STRATA]
    return R.first_wins(picks, "doc_id", "at", 28).select("doc_id", "list", F.col("place").cast("long").alias("place"))


@query("""WITH f AS (SELECT user_id, value AS r, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events), w AS (SELECT *, lag(r) OVER (PARTITION BY user_id ORDER BY i) AS p, lead(r) OVER (PARTITION BY user_id ORDER BY i) AS n FROM f)
SELECT w.user_id, w.i AS onset, CAST(coalesce((SELECT max(l.i) FROM f l WHERE l.user_id = w.user_id AND l.i < w.i AND l.r <= 20), -1) + 1 AS BIGINT) AS start FROM w WHERE r > 60 AND coalesce(p, 0) <= 60 AND n > 20""")
def walked_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each user's values rise above 60, and back to where they rose above 20. Spans are short, so that they are crossed."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1  # gives the frames their numbers
    frames = table(spark, sf_dir, "events").select("user_id", "value", number.cast("long").alias("i"))
    return R.onsets(frames, "user_id", "i", "value", 60.0, 20.0, span=16)


@query(f"""WITH {_WORDS}, j AS (SELECT word, t, places FROM s),
p AS (SELECT j.word, j.t, j.places, regexp_extract_all(j.word, '[^aeiou]*(?:ai|au|[aeiou])') AS open, regexp_extract(j.word, '[^aeiou]*$') AS rest, list_transform(range(1, 2 * len(places) + 1), lambda k: k) AS ks FROM j),
g AS (SELECT word, open, rest, len(places) AS n, list_transform(range(1, 2 * len(places) + 1), lambda k: CASE WHEN len(list_filter([t[places[(k - 1) % len(places) + 1]]], lambda v: v IN ('e', 'o', 'ai', 'au'))) > 0 THEN 'G'
    WHEN k = 2 * len(places) THEN CASE WHEN len(t) > places[-1] THEN 'G' ELSE 'L' END
    WHEN k % len(places) = 0 THEN CASE WHEN len(t) - places[-1] + places[1] - 1 >= 2 THEN 'G' ELSE 'L' END
    WHEN places[k % len(places) + 1] - places[k % len(places)] - 1 >= 2 THEN 'G' ELSE 'L' END) AS weights FROM p)
SELECT word, array_to_string(list_transform(range(1, n + 1), lambda i: open[i] || ':' || weights[i]), ' ') || CASE WHEN rest <> '' THEN ' ' || rest || ':-' ELSE '' END AS first, array_to_string(list_transform(range(1, n + 1), lambda i: open[i] || CASE WHEN i = n THEN rest ELSE '' END || ':' || weights[n + i]), ' ') AS second FROM g WHERE NOT regexp_matches(word, '^h') AND NOT regexp_matches(word, '[aeiou]$') OR regexp_matches(word, '^[^aeiou]')  AND regexp_matches(word, '[aeiou]$')""")
def annotated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every readable word twice in a line: its pieces, which give the word again, and the weight where the vowel stands.

    Words that end in a consonant and begin with h, or end and begin with a vowel, are read otherwise when they meet."""
    x = F.col("word")
    words = _words(spark, sf_dir).where((~x.rlike("^h") & ~x.rlike("[aeiou]$")) | (x.rlike("^[^aeiou]") & x.rlike("[aeiou]$")))
    rows = S.annotated(S.analyses(words.select(x.alias("verse_id"), F.concat(x, F.lit(" "), x).alias("text"))))
    shown = lambda k: F.array_join(F.transform(F.get("words", F.lit(k))["pieces"], lambda p: F.concat(p["text"], F.lit(":"), F.coalesce(p["weight"], F.lit("-")))), " ")
    return rows.select(F.col("verse_id").alias("word"), shown(0).alias("first"), shown(1).alias("second"))
