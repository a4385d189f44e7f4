"""Queries on corpora: joins, gates, statistics, samples, shards, quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kavyamill.operators import corpus as C
from kavyamill.plans.registry import query, table


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS count, min(l_quantity) AS min, round(quantile_cont(l_quantity, 0.05), 6) AS p05, round(quantile_cont(l_quantity, 0.5), 6) AS median, round(avg(l_quantity), 6) AS mean, round(quantile_cont(l_quantity, 0.95), 6) AS p95, max(l_quantity) AS max FROM lineitem GROUP BY ALL")
def group_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.distribution(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


@query("SELECT event_type, round(median(value) FILTER (WHERE user_id % 2 = 0), 6) AS even_median, round(median(value) FILTER (WHERE user_id % 2 = 1), 6) AS odd_median, round(coalesce(median(value) FILTER (WHERE value < 0), 150), 6) AS fallback FROM events GROUP BY 1")
def conditional_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda c: F.round(F.median(F.when(c, F.col("value"))), 6)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(of(F.col("user_id") % 2 == 0).alias("even_median"), of(F.col("user_id") % 2 == 1).alias("odd_median"), F.coalesce(of(F.col("value") < 0), F.lit(150.0)).alias("fallback"))


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE l.doc_id IS NULL) AS BIGINT) AS unknown, CAST(count(*) FILTER (WHERE quality = 1) AS BIGINT) AS good, CAST(count(*) FILTER (WHERE quality = 0) AS BIGINT) AS bad FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def two_level_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality").isNull()).alias("unknown"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))


@query("SELECT source, CAST(count(*) FILTER (WHERE l.doc_id IS NULL) AS BIGINT) AS unknown, CAST(count(*) AS BIGINT) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source ORDER BY unknown DESC, source LIMIT 12")
def topk_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve sources with most unlabelled documents: a top-k report."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.groupBy("source").agg(F.count_if(F.col("quality").isNull()).alias("unknown"), F.count("*").alias("n")).orderBy(F.desc("unknown"), "source").limit(12)


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n, arg_min(doc_id, doc_id) AS first_doc FROM documents GROUP BY lang")
def first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.min_by("doc_id", "doc_id").alias("first_doc"))


@query("SELECT CAST(count(*) AS BIGINT) AS docs, CAST(count(*) FILTER (WHERE length(text) < 200) AS BIGINT) AS too_short, CAST(count(*) FILTER (WHERE length(text) >= 200 AND lang <> 'en') AS BIGINT) AS other_language, CAST(count(*) FILTER (WHERE length(text) >= 200 AND lang = 'en') AS BIGINT) AS kept, CAST(sum(length(text)) AS BIGINT) AS chars_in, CAST(sum(length(text)) FILTER (WHERE length(text) >= 200 AND lang = 'en') AS BIGINT) AS chars_out FROM documents")
def stage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    short, english = F.length("text") < 200, F.col("lang") == "en"
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("docs"), F.count_if(short).alias("too_short"), F.count_if(~short & ~english).alias("other_language"), F.count_if(~short & english).alias("kept"), F.sum(F.length("text")).alias("chars_in"), F.sum(F.when(~short & english, F.length("text"))).alias("chars_out"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def exclusion_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return docs.join(labels.select("doc_id"), "doc_id", "left_semi").join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def exclusion_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id").join(toxic, "doc_id", "left_anti")


@query("SELECT user_id, ts, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"])


@query("WITH c AS (SELECT user_id AS k, value, event_type = 'error' AS gone FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1), s AS (SELECT c_custkey AS k, c_acctbal AS value FROM customer) SELECT coalesce(s.k, c.k) AS k, CASE WHEN c.k IS NOT NULL THEN c.value ELSE s.value END AS value FROM s FULL JOIN c ON s.k = c.k WHERE NOT coalesce(gone, false)")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = C.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"])
    changes = last.select(F.col("user_id").alias("k"), "value", (F.col("event_type") == "error").alias("gone"))
    state = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("value"))
    return C.upsert(state, changes, "k", ["value"], "gone")


@query("WITH p AS (SELECT d.doc_id, b.item_id, abs(length(d.text) - length(b.text)) AS gap FROM documents d, benchmark b) SELECT doc_id, arg_min(item_id, struct_pack(g := gap, i := item_id)) AS item_id, CAST(min(gap) AS BIGINT) AS gap FROM p GROUP BY doc_id")
def nearest_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark item nearest in length, the first of equal ones. Documents share few lengths, so lengths are
    matched, each with its two neighbours among the items' lengths, and documents take their length's match."""
    length = F.length("text").alias("n")
    docs = table(spark, sf_dir, "documents").select("doc_id", length)
    return docs.join(C.nearest_of(docs.select("n").distinct(), table(spark, sf_dir, "benchmark").select(length, "item_id"), "n", "item_id"), "n").select("doc_id", "item_id", "gap")


@query("WITH p AS (SELECT a.p_partkey, b.p_partkey AS other, abs(a.p_retailprice - b.p_retailprice) AS gap FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey) SELECT p_partkey, arg_min(other, struct_pack(g := gap, o := other)) AS other, round(min(gap), 6) AS gap FROM p GROUP BY p_partkey")
def asof_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of equal brand and type nearest in price, the first of equal ones."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.col("p_retailprice").alias("price"))
    return C.nearest_sibling(part, "p_partkey", ["p_brand", "p_type"], "price").select("p_partkey", F.col("sibling").alias("other"), F.round("gap", 6).alias("gap"))


@query("SELECT p_partkey, coalesce(CASE p_brand WHEN 'Brand#1' THEN 'own' WHEN 'Brand#2' THEN 'own' END, CASE p_type WHEN 'ECONOMY' THEN 'by type' WHEN 'STANDARD' THEN 'by type' END, 'default') AS tier FROM part")
def tiered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([("Brand#1", "own"), ("Brand#2", "own")], "p_brand string, tier string")
    by_type = spark.createDataFrame([("ECONOMY", "by type"), ("STANDARD", "by type")], "p_type string, tier string")
    return C.tiered(table(spark, sf_dir, "part"), [(own, ["p_brand"]), (by_type, ["p_type"])], "tier", "default").select("p_partkey", "tier")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) SELECT doc_id FROM r WHERE r IN (SELECT i * (SELECT any_value(n) - 1 FROM r) // 29 FROM range(30) t(i))")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty documents evenly spread over the ids: a sampling operator."""
    return C.systematic_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 30)


@query("WITH s AS (SELECT doc_id, lang, CASE WHEN lang = 'en' THEN 0 WHEN lang IN ('fr', 'de') THEN 1 ELSE 2 END AS stratum FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY stratum) AS n FROM s) SELECT doc_id, CAST(stratum AS INTEGER) AS stratum FROM r WHERE (stratum = 0 AND r IN (SELECT i * (SELECT any_value(n) - 1 FROM r WHERE stratum = 0) // 9 FROM range(10) t(i))) OR (stratum = 1 AND r IN (SELECT i * (SELECT any_value(n) - 1 FROM r WHERE stratum = 1) // 4 FROM range(5) t(i))) OR (stratum = 2 AND r IN (SELECT i * (SELECT any_value(n) - 1 FROM r WHERE stratum = 2) // 14 FROM range(15) t(i)))")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten, five and fifteen documents evenly spread over three strata, the first stratum of a document counting."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", 0).when(F.col("lang").isin("fr", "de"), 1).otherwise(2).alias("stratum"))
    parts = [C.systematic_sample(docs.where(F.col("stratum") == s), "doc_id", k) for s, k in ((0, 10), (1, 5), (2, 15))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("doc_id").agg(F.min("stratum").alias("stratum")).orderBy("stratum", "doc_id").limit(30)


@query("SELECT shard, CAST(count(*) AS BIGINT) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 4 AS shard FROM documents) GROUP BY shard")
def round_robin_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = C.with_rank(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])
    return ranked.groupBy((F.col("_rank") % 4).alias("shard")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT event_id, user_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 2 AS accepted FROM events")
def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two a day, so that the table, thin as it is, has both outcomes."""
    return C.within_quota(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 2).select("event_id", "user_id", "day", "accepted")


@query("SELECT conv_id, turn, length(text) / 100 AS duration, round(len(list_distinct(string_split(text, ' '))) / len(string_split(text, ' ')), 6) AS similarity, length(text) / 100 >= 1.5 AND length(text) / 100 <= CASE WHEN role = 'system' THEN 18 ELSE 6.5 END AND round(len(list_distinct(string_split(text, ' '))) / len(string_split(text, ' ')), 6) >= 0.35 AS is_gold FROM conversations")
def gold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pāda gate with text length as duration and the share of distinct words as similarity."""
    words = F.split("text", " ")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.length("text") / 100).alias("duration"), F.round(F.size(F.array_distinct(words)) / F.size(words), 6).alias("similarity"))
    return rows.select("conv_id", "turn", "duration", "similarity", C.gold_gate(F.col("duration"), F.col("similarity"), F.col("role") == "system").alias("is_gold"))


@query("SELECT conv_id, turn // 2 AS pair, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id, turn // 2")
def hemistich_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns joined in pairs, in order."""
    rows = C.hemistichs(table(spark, sf_dir, "conversations").withColumn("no", F.col("turn") + 1), ["conv_id"], "no", "text")
    return rows.select("conv_id", (F.col("half") - 1).alias("pair"), "text")


@query("SELECT 'documents' AS part, doc_id AS id, CAST(length(text) AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS role FROM documents UNION ALL SELECT 'conversations', conv_id * 1000 + turn, length(text), role FROM conversations UNION ALL SELECT 'benchmark', item_id, length(text), NULL FROM benchmark")
def union_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("part"), F.expr(i).alias("id"), F.length("text").cast("long").alias("size"), *(["role"] if t == "conversations" else [])) for t, i in (("documents", "doc_id"), ("conversations", "conv_id * 1000 + turn"), ("benchmark", "item_id"))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


@query("SELECT conv_id, turn, 'c' || printf('%05d', conv_id) || '_turn_' || turn || '.wav' AS fn, coalesce(nullif(role, 'user'), 'human') AS speaker FROM conversations")
def manifest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.format_string("c%05d_turn_%d.wav", "conv_id", "turn").alias("fn"), F.coalesce(F.nullif("role", F.lit("user")), F.lit("human")).alias("speaker"))


@query("SELECT text, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("text").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


_LINKS = "SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages"


@query(f"SELECT page_id, href, regexp_extract(url, '^[^:]*://[^/?#]*', 0) || href AS target, ends_with(href, '.txt') AS is_text FROM ({_LINKS}) WHERE starts_with(href, '/')")
def link_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    return pages.where(F.col("href").startswith("/")).select("page_id", "href", F.concat(F.regexp_extract("url", "^[^:]*://[^/?#]*", 0), "href").alias("target"), F.col("href").endswith(".txt").alias("is_text"))


@query(f"SELECT DISTINCT target FROM (SELECT regexp_extract(url, '^[^:]*://[^/?#]*', 0) || href AS target FROM ({_LINKS}) WHERE starts_with(href, '/')) WHERE target NOT IN (SELECT url FROM pages)")
def link_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets on the page's own host that have not been fetched."""
    return link_harvest(spark, sf_dir).select("target").distinct().join(table(spark, sf_dir, "pages").select(F.col("url").alias("target")), "target", "left_anti")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN json_extract(props, '$.missing') IS NULL THEN 'no such key' END AS error FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key of a JSON map, and an error column in place of an exception."""
    props = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.element_at(props, "k").cast("long").alias("k"), F.when(F.element_at(props, "missing").isNull(), "no such key").alias("error"))


@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, round(sum(CAST(o_totalprice * 100 AS BIGINT)) / 100, 2) AS total, CAST(count(*) FILTER (WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS BIGINT) AS returned FROM orders GROUP BY 1")
def gold_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, sums and flags over a join, the sum in whole cents."""
    flagged = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("flag", F.lit(True))
    orders = table(spark, sf_dir, "orders").join(flagged, "o_orderkey", "left")
    return orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100, 2).alias("total"), F.count_if("flag").alias("returned"))


@query("SELECT event_id, CAST(user_id * 131 + 7000 + k * 17 AS BIGINT) AS seed, CAST(k AS INTEGER) AS k FROM events, range(3) t(k)")
def seeded_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three candidates of each request, each with its own seed."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select("event_id", (F.col("user_id") * 131 + 7000 + F.col("k") * 17).alias("seed"), "k")


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, round(avg((t.role = 'user')::INT), 6) AS user_share, CAST(max(length(text)) AS BIGINT) AS longest FROM conversations t GROUP BY conv_id")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.round(F.avg((F.col("role") == "user").cast("int")), 6).alias("user_share"), F.max(F.length("text")).cast("long").alias("longest"))
