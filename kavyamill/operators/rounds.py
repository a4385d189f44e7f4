"""Work in rounds and in order: crawls to a fixed point, retries, running totals, ordered unions, onsets walked back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder that all executors share (spark.checkpoint.dir, else one in the warehouse)."""
    session = df.sparkSession
    context = session.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(session.conf.get("spark.checkpoint.dir", None) or f"{session.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.checkpoints")
    return df.checkpoint()


def crawl(links: DataFrame, seeds: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(node, depth) of all that the seeds reach over (source, target), depth being the least number of links.

    Each round follows the links of the last round's nodes and drops what was seen; it ends when nothing new is found,
    or after `most_rounds`. A node is written once, when it is found, so circles end. A source with very many links is
    split by the join; a target is reduced to one row before it is compared. Null ends lead nowhere; repeated links and
    seeds count once. The rounds are as many as the longest shortest path; one number a round reaches the driver.
    """
    e = links.select(F.col("source"), F.col("target").alias("node")).where("source is not null and node is not null")
    frontier = cut(seeds.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)))
    seen, depth = frontier, 0
    while not frontier.isEmpty() and depth != most_rounds:
        depth += 1
        reached = e.join(frontier.select(F.col("node").alias("source")), "source", "left_semi").select("node").distinct()
        frontier = cut(reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen


def retried(rows: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], most: int = 4) -> DataFrame:
    """rows with what attempt(open rows, number from 0) adds, of the first attempt in which its column `passed` is true,
    else of the last; `attempts` says how many were made.

    Only rows that have not passed are tried again. It ends after `most` rounds or when none is open. A null `passed`
    has not passed. Rows that repeat are tried each for itself.
    """
    done, waiting = [], rows
    for i in range(most):
        scored = cut(attempt(waiting, i).withColumn("passed", F.coalesce("passed", F.lit(False))).withColumn("attempts", F.lit(i + 1)))
        last = i == most - 1
        done.append(scored if last else scored.where("passed"))
        waiting = scored.where("not passed").select(*rows.columns)
        if last or waiting.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def running_total(df: DataFrame, order: list[str], size: Column, name: str = "before") -> DataFrame:
    """df with the sum of `size` over all rows before each in the order (ties of the order count as they come).

    Ranges of the order are summed apart, and only their sums, one row a range, are added up in one task. A null size
    counts as 0.
    """
    part, own = f"_{name}_part", f"_{name}_size"
    ranged = cut(df.withColumn(own, F.coalesce(size.cast("long"), F.lit(0).cast("long"))).repartitionByRange(*[F.col(c) for c in order]).withColumn(part, F.spark_partition_id()))
    sums = ranged.groupBy(part).agg(F.sum(own).alias("_sum"))
    starts = sums.select(part, (F.sum("_sum").over(Window.orderBy(part)) - F.col("_sum")).alias("_start"))  # one row a range
    within = F.sum(own).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(own)
    return ranged.withColumn("_within", within).join(F.broadcast(starts), part).withColumn(name, F.col("_start") + F.col("_within")).drop(part, own, "_start", "_within")


def file_numbers(df: DataFrame, order: list[str], size: Column, limit: int) -> DataFrame:
    """df with `file`, from 0: rows go on in order to the next file each time another `limit` bytes have begun."""
    return running_total(df, order, size).withColumn("file", F.floor(F.col("before") / limit).cast("long")).drop("before")


def write_rotated_by_bytes(df: DataFrame, order: list[str], column: str, limit: int, path: str) -> None:
    """Text lines of `column` in folders file=0, file=1, ...: each of about `limit` bytes, one file, in order."""
    numbered = file_numbers(df.where(F.col(column).isNotNull()), order, F.octet_length(column) + 1, limit)
    dealt = numbered.repartition("file").sortWithinPartitions("file", *order)
    dealt.select("file", F.col(column).alias("value")).write.mode("overwrite").partitionBy("file").text(path)


def first_wins(picks: list[DataFrame], key: str, order: str, most: int) -> DataFrame:
    """Rows of several lists one after another, each in its order, a key only where it comes first, `most` at most: a cap
    that is the feature. Adds `place`, from 0. The lists' columns agree.

    Keys are reduced to their first place before they are compared, and the cut is a top-k, so nothing is sorted whole.
    """
    rest = [c for c in picks[0].columns if c not in (key, order)]
    every = None
    for i, pick in enumerate(picks):
        rows = pick.select(F.lit(i).alias("list"), order, key, *rest)
        every = rows if every is None else every.unionByName(rows)
    first = every.groupBy(key).agg(F.min(F.struct("list", order, *rest)).alias("first")).select(key, "first.*")
    kept = first.orderBy("list", order, key).limit(most)
    return kept.withColumn("place", F.row_number().over(Window.orderBy("list", order, key)) - 1)  # `most` rows


def onsets(frames: DataFrame, clip: str, at: str, level: str, voice: float, floor: float, span: int = 4096) -> DataFrame:
    """(clip, onset, start) for each frame above `voice` whose predecessor isn't and whose successor is above `floor`:
    start is the frame after the last one at or under the floor before it, 0 where the clip never was so low.

    Frames are numbered from 0 without gaps. A clip is cut into spans of frames, each with its neighbours, and a span
    learns the last low frame of the spans before it from one row a span, so that no task holds a whole clip. A clip's
    last frame has no successor and is no onset; its first has no predecessor and can be one. Null levels are low.
    """
    rows = frames.select(clip, F.col(at).alias("i"), F.coalesce(level, F.lit(float("-inf"))).alias("r"))
    own = F.floor(F.col("i") / span)
    rows = rows.withColumn("own", own).withColumn("span", F.explode(F.array_distinct(F.array(own, F.floor((F.col("i") + 1) / span), F.floor((F.col("i") - 1) / span)))))
    w = Window.partitionBy(clip, "span").orderBy("i")
    low = F.when(F.col("r") <= floor, F.col("i"))
    before = F.last(low, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    seen = rows.withColumn("previous", F.lag("r").over(w)).withColumn("next", F.lead("r").over(w)).withColumn("low", before).where("span = own")
    found = seen.where((F.col("r") > voice) & ~F.coalesce(F.col("previous") > voice, F.lit(False)) & (F.col("next") > floor)).select(clip, "span", "i", "low")
    lows = rows.where("span = own").groupBy(clip, "span").agg(F.max(low).alias("last"))
    carried = lows.withColumn("carried", F.max("last").over(Window.partitionBy(clip).orderBy("span").rowsBetween(Window.unboundedPreceding, -1))).select(clip, "span", "carried")
    return found.join(carried, [clip, "span"]).select(clip, F.col("i").alias("onset"), (F.coalesce("low", "carried", F.lit(-1)) + 1).alias("start"))
