"""Timelines: runs, interval and positional joins, cumulative rounding, windows with margins, dividers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys: list[str], order: str | list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def runs(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal values: keys, value, first, last (of order) and n. Filter blanks out first if they don't break runs."""
    w = _w(keys, order)
    new = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return marked.groupBy(*keys, "_run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")


def ctc_decode(df: DataFrame, keys: list[str], order: str, token: str, blank: Column) -> DataFrame:
    """Tokens that differ from the one before, blanks between included, with the blanks left out, joined in order."""
    before = F.lag(token).over(_w(keys, order))
    kept = df.withColumn("_keep", ~F.col(token).eqNullSafe(before) & (F.col(token) != blank)).where("_keep")
    return kept.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, token))), lambda x: x[token].cast("string")), " ").alias("decoded"))


def cumulative_rounding(df: DataFrame, keys: list[str], order: str, duration: str) -> DataFrame:
    """Whole frames by rounded running ends, so that rounding errors don't add up; one frame at least."""
    w = _w(keys, order)
    end = F.bround(F.sum(duration).over(w.rowsBetween(Window.unboundedPreceding, 0)), 0).cast("long")
    rows = df.withColumn("end_frame", end)
    return rows.withColumn("frames", F.greatest(F.lit(1), F.col("end_frame") - F.coalesce(F.lag("end_frame").over(w), F.lit(0))))


def interval_join(points: DataFrame, spans: DataFrame, point: str, start: str, end: str, width: float, keys: list[str] | None = None) -> DataFrame:
    """Points with the spans that hold them (start <= point < end): an equi-join on bins of `width`, each span in all
    bins that it reaches, so that nothing is compared with everything. Choose a width near a usual span's."""
    keys = keys or []
    left = points.withColumn("_bin", F.floor(F.col(point) / width))
    right = spans.where(F.col(start) < F.col(end)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return left.join(right, [*keys, "_bin"]).where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_bin")


def positional_join(items: DataFrame, owners: DataFrame, keys: list[str], item_order: str, owner_order: str, size: str) -> DataFrame:
    """Each owner, in order, takes the next `size` items: running totals turn it into a join of places. Each place
    of an owner is one row, so the join is an equi-join."""
    placed = items.withColumn("_at", F.row_number().over(_w(keys, item_order)))
    end = F.sum(size).over(_w(keys, owner_order).rowsBetween(Window.unboundedPreceding, 0))
    spans = owners.withColumn("_end", end).where(F.col(size) > 0)
    places = spans.withColumn("_at", F.explode(F.sequence((F.col("_end") - F.col(size) + 1).cast("int"), F.col("_end").cast("int")))).drop("_end")
    return placed.join(places, [*keys, "_at"]).drop("_at")


def nearest(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, keep: list[str], tie: str) -> DataFrame:
    """Each left row with the right row of equal keys whose `b` is nearest to its `a`; ties go to the least `tie`.
    left must have a column `_row` that names its rows."""
    pairs = left.join(right, on)
    best = F.min(F.struct(F.abs(F.col(a) - F.col(b)).alias("gap"), F.col(tie).alias("tie"), *[F.col(k).alias(k) for k in keep])).alias("best")
    return pairs.groupBy("_row").agg(best).select("_row", "best.gap", *[f"best.{k}" for k in keep])


def dividers(spans: DataFrame, keys: list[str], order: str, start: str, end: str) -> DataFrame:
    """The middle between each span's end and the next one's start; the last divides at its end. gap: whether there
    is room for a quiet place."""
    nxt = F.lead(start).over(_w(keys, order))
    return spans.withColumn("divider", F.bround(F.coalesce((F.col(end) + nxt) / 2, F.col(end)), 3)).withColumn("gap", F.coalesce(nxt > F.col(end) + 0.04, F.lit(False)))


def quietest(frames: DataFrame, spans: DataFrame, keys: list[str], time: str, level: str, start: str, end: str, width: float) -> DataFrame:
    """The time and level (dB) of the least level within each span; the first of equal ones."""
    held = interval_join(frames, spans, time, start, end, width, keys)
    best = held.groupBy(*keys, start, end).agg(F.min_by(time, F.struct(level, time)).alias("at"), F.min(level).alias("low"))
    return best.withColumn("db", F.bround(20 * F.log10(F.col("low") + 1e-9), 1))


def is_monotonic(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows at which the value does not rise: empty if all is well."""
    return df.withColumn("_before", F.lag(value).over(_w(keys, order))).where(F.col(value) <= F.col("_before")).drop("_before")


def ordered_totals(df: DataFrame, keys: list[str], order: str | list[str], value: str) -> DataFrame:
    """keys, n (rows) and total: each group's values added one after the other, as a sum of doubles depends on their order.
    Null values count as rows only; a total of none is null. A group is sorted, with spill, and never held as an array."""
    w = _w(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    running = df.select(*keys, F.count("*").over(w).alias("_n"), F.sum(value).over(w).alias("_total"))
    return running.groupBy(*keys).agg(F.max("_n").alias("n"), F.max_by("_total", "_n").alias("total"))


def clamp_rising(values: Column, step: float) -> Column:
    """An ordered array made to rise: a value not above the one before becomes that plus `step`."""
    start = F.array().cast("array<double>")
    rise = lambda a, x: F.concat(a, F.array(F.when((F.size(a) > 0) & (x <= F.element_at(a, -1)), F.element_at(a, -1) + step).otherwise(x)))
    return F.aggregate(values, start, lambda a, x: F.when(F.size(a) == 0, F.array(x)).otherwise(rise(a, x)))


def windows_with_margin(df: DataFrame, time: str, size: float, hop: float, margin: float) -> DataFrame:
    """Each row once for each window [k hop, k hop + size) that holds it; inner: at least `margin` from the ends, the
    first window's start excepted. With margin <= (size - hop) / 2 inner windows leave no gap."""
    first = F.greatest(F.lit(0), F.floor((F.col(time) - size) / hop) + 1)
    rows = df.withColumn("k", F.explode(F.sequence(first, F.floor(F.col(time) / hop))))
    begin = F.col("k") * F.lit(float(hop))
    inner = ((F.col("k") == 0) | (F.col(time) >= begin + margin)) & (F.col(time) < begin + (size - margin))
    return rows.withColumn("window_start", begin).withColumn("inner", inner)


def halo_blocks(df: DataFrame, order: str, size: int) -> DataFrame:
    """Blocks of `size` rows by their number, each with one neighbour before and after, marked as halo."""
    own = F.floor(F.col(order) / size)
    near = F.array_distinct(F.array(own, F.floor((F.col(order) + 1) / size), F.floor((F.col(order) - 1) / size)))
    rows = df.withColumn("block", F.explode(near)).withColumn("halo", F.col("block") != own)
    return rows.where(F.col("block") >= 0)


def greedy_merge(lengths: Column, least: float) -> Column:
    """Neighbouring pieces merged until each is `least` long; what is left joins the last."""
    start = F.struct(F.array().cast("array<double>").alias("done"), F.lit(0.0).alias("now"))

    def step(s: Column, x: Column) -> Column:
        total = s["now"] + x
        full = total >= least
        return F.struct(F.when(full, F.concat(s["done"], F.array(total))).otherwise(s["done"]).alias("done"), F.when(full, F.lit(0.0)).otherwise(total).alias("now"))

    def finish(s: Column) -> Column:
        rest = F.when(F.size(s["done"]) == 0, F.array(s["now"])).otherwise(F.concat(F.slice(s["done"], 1, F.greatest(F.size(s["done"]) - 1, F.lit(0))), F.array(F.element_at(s["done"], -1) + s["now"])))
        return F.when(s["now"] > 0, rest).otherwise(s["done"])

    return F.aggregate(lengths, start, step, finish)


def rms(samples: Column, window: int, hop: int) -> Column:
    """Root mean squares of the windows that begin at each hop and end before the last sample."""
    last = F.size(samples) - window - 1
    frame = lambda i: F.sqrt(F.aggregate(F.slice(samples, i + 1, window), F.lit(0.0), lambda a, x: a + x * x) / window + 1e-12)
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last, F.lit(hop)), frame)).otherwise(F.array().cast("array<double>"))
