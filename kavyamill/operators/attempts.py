"""A meter for a verse by several readings of it, worked out in its row one after the other: the first that holds wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kavyamill import dims
from kavyamill.operators import meter as M

#: Readings in their order of precedence.
EXACT, WHOLE, DOUBLED, FIRST_EXACT, FIRST = "exact", "whole", "doubled", "first-exact", "first"
ORDER = (EXACT, WHOLE, DOUBLED, FIRST_EXACT, FIRST)
#: A doubled half is not taken for this meter.
NOT_DOUBLED = "vegavati"


def _stems(spark: SparkSession) -> DataFrame:
    """The first meter of equal pādas for each stem, a fixed table."""
    sama: dict[str, tuple] = {}
    for r in dims.meter_rows():
        if r[3] == "sama-vrtta":
            sama.setdefault(r[5][0][:-1], (r[5][0][:-1], (r[1], len(r[5][0]))))
    return spark.createDataFrame(list(sama.values()), "stem string, meter struct<meter_id:string,syllables:int>")


def _repeated(rows: DataFrame, pattern: str, name: str, meters: DataFrame) -> DataFrame:
    """rows with `name`, (meter_id, syllables) of repeated() or null, within the row: a pattern meets only meters of its
    length by broadcast joins on the pāda's stem, and only if all its parts have one stem."""
    p, n, made = F.col(pattern), F.length(pattern), rows
    for k in range(1, 5):
        size = (n / k).cast("int")
        stem = lambda i, size=size: F.substr(p, F.lit(i) * size + 1, size - 1)
        same = (n > 0) & (n % k == 0)
        for i in range(1, k):
            same = same & (stem(i) == stem(0))
        made = made.withColumn(f"_stem{k}", F.when(same, stem(0))).join(F.broadcast(meters.toDF(f"_stem{k}", f"_meter{k}")), f"_stem{k}", "left")
    return made.select(*rows.columns, F.coalesce(*[F.col(f"_meter{k}") for k in range(1, 5)]).alias(name))


def repeated(rows: DataFrame, pattern: str, key: list[str]) -> DataFrame:
    """(key, meter_id, syllables): the meter of equal pādas that a pattern is one, two, three or four of, each last place
    free; of several the one of the longest pāda, then the first of the catalogue. Patterns that fit none have no row.
    """
    found = _repeated(rows.select(*key, F.col(pattern).alias("_pattern")), "_pattern", "_found", _stems(rows.sparkSession))
    return found.where("_found is not null").select(*key, "_found.meter_id", "_found.syllables")


def identified(verses: DataFrame, tradition: str = "auto") -> DataFrame:
    """verse_id, strategy, meter_id, status and syllables of each of (verse_id, lines), lines being weight patterns.

    exact: the whole is equal pādas of one meter; whole: the verdict on the lines; doubled: that on the lines twice, but
    for NOT_DOUBLED; first-exact and first: the same of the first of two or more lines. The first that is not
    unidentified wins; without one all but verse_id are null. syllables are those of a pāda where the reading knows them.
    Null lines, empty ones and verses without lines say nothing. A verse is read in its row, nothing is shuffled, and a
    reading is worked out only where none before it held. Single lines that a verdict would take by their pattern alone
    are equal pādas, so M.settled() leaves out nothing that could win.
    """
    lines = F.filter("lines", lambda x: x.isNotNull() & (x != ""))
    made = verses.select("verse_id", lines.alias("lines")).withColumn("lines", F.when(F.size("lines") > 0, F.col("lines")))
    made = made.withColumn("best", F.lit(None).cast("struct<strategy:string,meter_id:string,status:string,syllables:int>"))
    several, open_ = F.size("lines") >= 2, F.col("best").isNull()

    meters, judge = _stems(verses.sparkSession), M.settled(verses.sparkSession, ["verse_id", "lines", "before"])

    def exact(rows: DataFrame, strategy: str, pattern: Column) -> DataFrame:
        found = _repeated(rows.withColumn("tried", F.when(open_, pattern)), "tried", "found", meters)
        said = F.struct(F.lit(strategy).alias("strategy"), F.col("found.meter_id").alias("meter_id"), F.lit("exact").alias("status"), F.col("found.syllables").alias("syllables"))
        return found.select("verse_id", "lines", F.when(F.col("found").isNotNull(), said).otherwise(F.col("best")).alias("best"))

    def verdict(rows: DataFrame, strategy: str, units: Column) -> DataFrame:
        found = judge(rows.withColumn("units", F.when(open_, units)).withColumn("asked", F.lit(tradition)).withColumnRenamed("best", "before"))
        said = F.struct(F.lit(strategy).alias("strategy"), F.col("primary_id").alias("meter_id"), F.col("status"), F.lit(None).cast("int").alias("syllables"))
        holds = F.col("status").isNotNull() & ((F.lit(strategy) != DOUBLED) | (F.col("primary_id") != NOT_DOUBLED))
        return found.select("verse_id", "lines", F.when(holds, said).otherwise(F.col("before")).alias("best"))

    made = exact(made, EXACT, F.array_join("lines", ""))
    made = verdict(made, WHOLE, F.col("lines"))
    made = verdict(made, DOUBLED, F.concat("lines", "lines"))
    made = exact(made, FIRST_EXACT, F.when(several, F.get("lines", F.lit(0))))
    made = verdict(made, FIRST, F.when(several, F.slice("lines", 1, 1)))
    return made.select("verse_id", "best.strategy", "best.meter_id", "best.status", "best.syllables")
