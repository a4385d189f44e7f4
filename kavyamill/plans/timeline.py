"""Queries on timelines, carried by the events table: users are clips, events are frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kavyamill.operators import timeline as T
from kavyamill.plans.registry import query, table

_TOKEN = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts", F.expr(_TOKEN).alias("token"))


@query("WITH f AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS p FROM events WHERE event_type <> 'view' WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), g AS (SELECT *, sum(CASE WHEN p IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM f) SELECT user_id, min(event_type) AS event_type, min(event_id) AS first, max(event_id) AS last, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY user_id, g")
def rle_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal labels; blanks ('view') are skipped first, so they don't break a run."""
    return T.runs(_frames(spark, sf_dir).where("event_type <> 'view'"), ["user_id"], "event_id", "event_type")


@query(f"WITH f AS (SELECT user_id, event_id, {_TOKEN} AS token FROM events), g AS (SELECT *, lag(token) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM f) SELECT user_id, string_agg(token::VARCHAR, ' ' ORDER BY event_id) AS decoded FROM g WHERE token IS DISTINCT FROM p AND token <> 0 GROUP BY user_id")
def ctc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ctc_decode(_frames(spark, sf_dir), ["user_id"], "event_id", "token", F.lit(0))


@query("WITH s AS (SELECT user_id, event_id, CAST(round_even(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) / 100, 0) AS BIGINT) AS end_frame FROM events) SELECT user_id, event_id, end_frame, greatest(1, end_frame - coalesce(lag(end_frame) OVER (PARTITION BY user_id ORDER BY event_id), 0)) AS frames FROM s")
def cumulative_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values are hundredths: summed as whole numbers, so that both engines round the same totals."""
    rows = _frames(spark, sf_dir).withColumn("c", F.round(F.col("value") * 100).cast("long"))
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = rows.withColumn("end_frame", F.bround(F.sum("c").over(w) / 100, 0).cast("long"))
    return rows.select("user_id", "event_id", "end_frame", F.greatest(F.lit(1), F.col("end_frame") - F.coalesce(F.lag("end_frame").over(w), F.lit(0))).alias("frames"))


@query("WITH s AS (SELECT user_id, sum(CAST(round(value) AS BIGINT)) AS total, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id), p AS (SELECT user_id, event_id, CAST(round(value) AS BIGINT) AS d, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AS is_last FROM events) SELECT user_id, event_id, CASE WHEN is_last THEN greatest(4, d + 1000 - total % 1000) ELSE d END AS frames FROM p JOIN s USING (user_id)")
def residual_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last frame takes up what is missing to a whole thousand."""
    rows = _frames(spark, sf_dir).withColumn("d", F.round("value").cast("long"))
    by = Window.partitionBy("user_id")
    rows = rows.withColumn("total", F.sum("d").over(by)).withColumn("is_last", F.col("event_id") == F.max("event_id").over(by))
    return rows.select("user_id", "event_id", F.when(F.col("is_last"), F.greatest(F.lit(4), F.col("d") + 1000 - F.col("total") % 1000)).otherwise(F.col("d")).alias("frames"))


@query("WITH s AS (SELECT event_id AS span_id, user_id, value AS t0, value + 5 AS t1 FROM events WHERE event_type = 'purchase') SELECT p.event_id, s.span_id, p.user_id FROM events p JOIN s ON p.user_id = s.user_id AND p.value >= s.t0 AND p.value < s.t1 WHERE p.event_type = 'click'")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir)
    spans = f.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("span_id"), F.col("value").alias("t0"), (F.col("value") + 5).alias("t1"))
    points = f.where("event_type = 'click'").select("user_id", "event_id", "value")
    return T.interval_join(points, spans, "value", "t0", "t1", 5.0, ["user_id"]).select("event_id", "span_id", "user_id")


@query("WITH i AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS at FROM events WHERE event_type <> 'signup'), o AS (SELECT user_id, event_id AS owner, event_id % 4 AS k, sum(event_id % 4) OVER (PARTITION BY user_id ORDER BY event_id) AS e FROM events WHERE event_type = 'signup') SELECT i.user_id, i.event_id, o.owner FROM i JOIN o ON i.user_id = o.user_id AND i.at > o.e - o.k AND i.at <= o.e")
def positional_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signup takes the next event_id % 4 of its user's other events."""
    f = _frames(spark, sf_dir)
    owners = f.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("owner"), (F.col("event_id") % 4).alias("k"))
    items = f.where("event_type <> 'signup'").select("user_id", "event_id")
    return T.positional_join(items, owners, ["user_id"], "event_id", "owner", "k").select("user_id", "event_id", "owner")


_SECONDS = "epoch_us(ts) // 1000000 - 1704067200"


@query(f"WITH e AS (SELECT event_id, {_SECONDS} AS t FROM events), k AS (SELECT event_id, t, unnest(generate_series(greatest(0, CAST(floor((t - 28800) / 18000) AS BIGINT) + 1), t // 18000)) AS k FROM e) SELECT CAST(k * 18000 AS BIGINT) AS window_start, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE (k = 0 OR t >= k * 18000 + 5400) AND t < k * 18000 + 23400) AS BIGINT) AS inner_n FROM k GROUP BY k")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 8 hours every 5, and how many of their rows are clear of the margins."""
    e = table(spark, sf_dir, "events").select("event_id", (F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))).alias("t"))
    rows = T.windows_with_margin(e, "t", 28800, 18000, 5400)
    return rows.groupBy(F.col("window_start").cast("long").alias("window_start")).agg(F.count("*").alias("n"), F.count_if("inner").alias("inner_n"))


@query("WITH b AS (SELECT o_orderkey AS k, unnest(list_distinct([k // 100, (k + 1) // 100, CASE WHEN k > 0 THEN (k - 1) // 100 ELSE 0 END])) AS block FROM orders) SELECT CAST(block AS BIGINT) AS block, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE block <> k // 100) AS BIGINT) AS halo FROM b GROUP BY block")
def halo_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = T.halo_blocks(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), "k", 100)
    return blocks.groupBy("block").agg(F.count("*").alias("rows"), F.count_if("halo").alias("halo"))


@query("WITH t AS (SELECT max(value) AS total FROM events) SELECT event_id, round_even(greatest(0, value - 2), 3) AS st, round_even(least(total, value + 2), 3) AS et FROM events, t")
def padded_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    total = F.broadcast(e.agg(F.max("value").alias("total")))  # one row
    return e.crossJoin(total).select("event_id", F.bround(F.greatest(F.lit(0.0), F.col("value") - 2), 3).alias("st"), F.bround(F.least("total", F.col("value") + 2), 3).alias("et"))


_SPANS = "SELECT user_id, event_id, event_id * 1.0 AS st, event_id + (event_id % 7) / 10.0 AS et FROM events"


@query(f"WITH s AS ({_SPANS}), n AS (SELECT *, lead(st) OVER (PARTITION BY user_id ORDER BY event_id) AS nx FROM s) SELECT user_id, event_id, round_even(CAST(coalesce((et + nx) / 2, et) AS DOUBLE), 3) AS divider, coalesce(nx > et + 0.04, false) AS gap FROM n")
def divider_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").cast("double").alias("st"), (F.col("event_id") + (F.col("event_id") % 7) / 10).alias("et"))
    return T.dividers(spans, ["user_id"], "event_id", "st", "et").select("user_id", "event_id", "divider", "gap")


@query("SELECT user_id, event_id, coalesce(CASE WHEN lag(event_type) OVER w = 'error' THEN lag(value) OVER w END, value) AS start_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def cascade_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edited row ('error') hands its end to the next one as its start."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    handed = F.when(F.lag("event_type").over(w) == "error", F.lag("value").over(w))
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.coalesce(handed, "value").alias("start_value"))


@query("WITH s AS (SELECT user_id, arg_min(event_id, struct_pack(v := value, e := event_id)) AS quietest, arg_max(event_id, struct_pack(v := value, e := -event_id)) AS loudest, min(value) AS low FROM events GROUP BY user_id) SELECT user_id, quietest, loudest, round(20 * log10(low + 1e-9), 1) AS db FROM s")
def quiet_and_loud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least and the greatest value of each clip, the first of equal ones, and the least in decibels."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("quietest"), F.max_by("event_id", F.struct(F.col("value"), -F.col("event_id"))).alias("loudest"), F.min("value").alias("low"))
    return e.select("user_id", "quietest", "loudest", F.round(20 * F.log10(F.col("low") + 1e-9), 1).alias("db"))


@query("WITH f AS (SELECT user_id, event_id, value < 30 AS quiet, lag(value < 30) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events), g AS (SELECT *, sum(CASE WHEN p IS DISTINCT FROM quiet THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM f) SELECT user_id, min(event_id) AS first, max(event_id) AS last, CAST(count(*) AS BIGINT) AS n FROM g WHERE quiet GROUP BY user_id, g HAVING count(*) >= 3")
def silent_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three or more quiet frames."""
    f = table(spark, sf_dir, "events").withColumn("quiet", F.col("value") < 30)
    return T.runs(f, ["user_id"], "event_id", "quiet").where("quiet and n >= 3").select("user_id", "first", "last", "n")


@query("SELECT user_id, round(quantile_cont(value, 0.5), 6) AS median, round(regr_slope(value, event_id), 6) AS slope, round(max(value) - min(value), 6) AS range, round(avg((value > 20)::INT), 6) AS voiced, round(avg(value), 6) AS energy FROM events GROUP BY user_id")
def slope_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.median(v), 6).alias("median"), F.round(F.regr_slope("value", "event_id"), 6).alias("slope"), F.round(F.max(v) - F.min(v), 6).alias("range"), F.round(F.avg((v > 20).cast("int")), 6).alias("voiced"), F.round(F.avg(v), 6).alias("energy"))


@query("WITH c AS (SELECT user_id, CAST(floor((1200 * log2(value / 110) + 6000) % 1200 / 5) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, arg_max(bin, struct_pack(n := n, b := -bin)) AS peak, CAST(max(n) AS BIGINT) AS n FROM c GROUP BY user_id")
def histogram_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fullest of 240 bins of five cents within the octave."""
    cents = (1200 * F.log2(F.col("value") / 110) + 6000) % 1200
    bins = table(spark, sf_dir, "events").groupBy("user_id", F.floor(cents / 5).alias("bin")).agg(F.count("*").alias("n"))
    return bins.groupBy("user_id").agg(F.max_by("bin", F.struct(F.col("n"), -F.col("bin"))).alias("peak"), F.max("n").alias("n"))


@query("WITH RECURSIVE a AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY user_id), f AS (SELECT user_id, v, 1 AS i, CAST(v[1] AS DOUBLE) AS x FROM a UNION ALL SELECT user_id, v, i + 1, CASE WHEN v[i + 1] <= x THEN x + 0.5 ELSE v[i + 1] END FROM f WHERE i < len(v)) SELECT user_id, CAST(i AS BIGINT) AS pos, round(x, 6) AS risen FROM f")
def clamp_rising(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("v"))
    risen = T.clamp_rising(F.transform("v", lambda x: x["value"]), 0.5)
    return a.select("user_id", F.posexplode(risen).alias("pos", "x")).select("user_id", (F.col("pos") + 1).cast("long").alias("pos"), F.round("x", 6).alias("risen"))


@query("WITH t AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events), m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1) SELECT event_type, round(12 * log2(max(value) / m), 6) AS top_semitones, round(sqrt(avg(value * value) + 1e-12), 6) AS rms FROM t JOIN m USING (event_type) GROUP BY event_type, m")
def level_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(12 * F.log2(F.max(v) / F.median(v)), 6).alias("top_semitones"), F.round(F.sqrt(F.avg(v * v) + 1e-12), 6).alias("rms"))


@query("WITH RECURSIVE a AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY user_id), f AS (SELECT user_id, v, 1 AS i, CAST(v[1] AS DOUBLE) AS now, CAST(0 AS BIGINT) AS done FROM a UNION ALL SELECT user_id, v, i + 1, CASE WHEN now >= 100 THEN v[i + 1] ELSE now + v[i + 1] END, done + (now >= 100)::BIGINT FROM f WHERE i < len(v)) SELECT user_id, greatest(1, done + (now >= 100)::BIGINT) AS pieces FROM f WHERE i = len(v)")
def greedy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in order, merged until a piece reaches 100; the rest joins the last piece."""
    a = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("v"))
    return a.select("user_id", F.size(T.greedy_merge(F.transform("v", lambda x: x["value"]), 100.0)).cast("long").alias("pieces"))
