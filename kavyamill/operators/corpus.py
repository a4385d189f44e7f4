"""Building corpora: gates, lookups in tiers, samples, shards, latest-wins state, keyed quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gold_gate(duration: Column, similarity: Column, is_special: Column) -> Column:
    """A pāda's gate: 1.5 to 6.5 seconds (18 for special units) and similarity of 0.35."""
    return (duration >= 1.5) & (duration <= F.when(is_special, 18.0).otherwise(6.5)) & (similarity >= 0.35)


def hemistich_gate(duration: Column, similarity: Column) -> Column:
    return (similarity >= 0.40) & (duration <= 14.0)


def hemistichs(padas: DataFrame, keys: list[str], pada_no: str, value: str) -> DataFrame:
    """Pādas 1-2 and 3-4 of a verse as one row each, their values joined in order."""
    rows = padas.groupBy(*keys, F.ceil(F.col(pada_no) / 2).alias("half")).agg(F.array_sort(F.collect_list(F.struct(pada_no, value))).alias("_parts"))
    return rows.select(*keys, "half", F.array_join(F.transform("_parts", lambda x: x[value]), " ").alias(value))


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: a struct maximum, which the map side already reduces."""
    rest = [c for c in log.columns if c not in (key, *order)]
    best = log.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_last"))
    return best.select(key, *[f"_last.{c}" for c in (*order, *rest)])


def upsert(state: DataFrame, changes: DataFrame, key: str, values: list[str], deleted: str) -> DataFrame:
    """state with each key's change put in its place; a deleted key goes, a new one comes."""
    new = changes.select(key, F.lit(True).alias("_hit"), deleted, *[F.col(v).alias(f"_{v}") for v in values])
    joined = state.join(new, key, "full_outer").where(~F.coalesce(F.col(deleted), F.lit(False)))
    return joined.select(key, *[F.when(F.col("_hit"), F.col(f"_{v}")).otherwise(F.col(v)).alias(v) for v in values])


def tiered(rows: DataFrame, tiers: list[tuple[DataFrame, list[str]]], value: str, default: str) -> DataFrame:
    """rows with the value of the first tier (a small keyed table, broadcast by size) that has their key."""
    found = []
    for i, (tier, keys) in enumerate(tiers):
        rows = rows.join(tier.select(*keys, F.col(value).alias(f"_tier{i}")), keys, "left")
        found.append(F.col(f"_tier{i}"))
    return rows.withColumn(value, F.coalesce(*found, F.lit(default))).drop(*[f"_tier{i}" for i in range(len(tiers))])


def systematic_sample(df: DataFrame, order: str | list[str], k: int) -> DataFrame:
    """k rows evenly spread over the order: places int(i (n - 1) / (k - 1)); all rows if there are no more than k.

    Ranks come from a range partitioning and counts by partition, not from one task that holds all rows.
    """
    order = [order] if isinstance(order, str) else order
    ranked = with_rank(df, order)
    n = ranked.agg(F.max("_rank")).first()[0]
    if n is None or n + 1 <= k:
        return ranked.drop("_rank")
    wanted = sorted({i * n // (k - 1) for i in range(k)})
    return ranked.where(F.col("_rank").isin(wanted)).drop("_rank")


def with_rank(df: DataFrame, order: list[str]) -> DataFrame:
    """df with _rank, its place from 0 in the order. The order must be unique for the ranks to be the same each time."""
    parts = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id())
    local = parts.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    counts = local.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))  # one row a partition
    return local.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn("_rank", F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")


def distribution(df: DataFrame, by: list[str], value: str, digits: int = 6) -> DataFrame:
    """count, min, p05, median, mean, p95, max of each group, percentiles interpolated."""
    v = F.col(value)
    at = lambda p: F.round(F.percentile(v, p), digits)
    return df.groupBy(*by).agg(F.count("*").alias("count"), F.min(v).alias("min"), at(0.05).alias("p05"), at(0.5).alias("median"), F.round(F.avg(v), digits).alias("mean"), at(0.95).alias("p95"), F.max(v).alias("max"))


def within_quota(events: DataFrame, key: str, time: str, order: str, limit: int = 10) -> DataFrame:
    """events with `accepted`: the first `limit` of each key and day. Rejected ones don't count."""
    day = F.to_date(time)
    place = F.row_number().over(Window.partitionBy(key, day).orderBy(time, order))
    return events.withColumn("day", day).withColumn("accepted", place <= limit)


def client_key(direct: Column, forwarded: Column, peer: Column) -> Column:
    first = F.trim(F.get(F.split(forwarded, ","), F.lit(0)))
    return F.coalesce(F.nullif(direct, F.lit("")), F.nullif(first, F.lit("")), F.nullif(peer, F.lit("")), F.lit("unknown"))


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("true", "1", "yes"), F.lit(False))


def nearest_sibling(rows: DataFrame, ident: str, on: list[str], value: str) -> DataFrame:
    """Each row with the row of equal keys nearest in value, the least id of equal ones: by the neighbours in the order
    of distinct values, and the two least ids of each value, not by pairs."""
    place = F.row_number().over(Window.partitionBy(*on, value).orderBy(ident))
    levels = rows.withColumn("_p", place).groupBy(*on, value).agg(F.min(ident).alias("_m1"), F.min(F.when(F.col("_p") == 2, F.col(ident))).alias("_m2"))
    w = Window.partitionBy(*on).orderBy(value)
    sides = [F.struct(F.abs(F.col(value) - f(value, 1).over(w)).alias("gap"), f("_m1", 1).over(w).alias("sibling")) for f in (F.lag, F.lead)]
    levels = levels.select(*on, value, "_m1", "_m2", F.array(*sides).alias("_sides"))
    own = F.when(F.col(ident) == F.col("_m1"), F.col("_m2")).otherwise(F.col("_m1"))
    every = F.concat(F.array(F.struct(F.lit(0.0).alias("gap"), own.alias("sibling"))), F.col("_sides"))
    joined = rows.join(levels, [*on, value]).withColumn("_best", F.array_min(F.filter(every, lambda x: x["sibling"].isNotNull())))
    return joined.where("_best is not null").select(*rows.columns, "_best.gap", "_best.sibling")


def nearest_of(values: DataFrame, refs: DataFrame, value: str, ident: str, span: int = 4096) -> DataFrame:
    """(value, ident, gap) for each of the distinct integer values: the reference nearest in value, the least id of equal ones.

    Both sides are laid in order within spans of `span`; the nearest on either side stands in the span, or is the last
    of the spans before or the first of those after, which one row a span tells. Null values have no reference, and
    without references there are no rows.
    """
    at = refs.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(ident).alias(ident))
    here = F.struct(F.col(value).alias("v"), F.col(ident).alias("id"))
    rows = values.select(value, F.lit(None).cast(at.schema[ident].dataType).alias(ident), F.lit(True).alias("asked")).unionByName(at.withColumn("asked", F.lit(False))).where(F.col(value).isNotNull())
    rows = rows.withColumn("span", F.floor(F.col(value) / span)).withColumn("ref", F.when(~F.col("asked"), here))
    w = Window.partitionBy("span").orderBy(value)
    near = rows.withColumn("below", F.last("ref", ignorenulls=True).over(w)).withColumn("above", F.first("ref", ignorenulls=True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))).where("asked")
    ends = rows.groupBy("span").agg(F.max("ref").alias("top"), F.min("ref").alias("low"))
    by_span = Window.orderBy("span")  # one row a span
    ends = ends.select("span", F.last("top", ignorenulls=True).over(by_span.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("low", ignorenulls=True).over(by_span.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    found = near.join(ends, "span")
    choices = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.v") - F.col(value)).cast("long").alias("gap"), F.col(f"{c}.id").alias("id"))) for c in ("below", "above", "before", "after")]))
    best = found.withColumn("best", F.array_min(choices)).where("best is not null")
    return best.select(value, F.col("best.id").alias(ident), F.col("best.gap").alias("gap"))
