"""Name to query and name to oracle SQL for the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Worked cases that read no table: tests run them with their SQL; they are not queries.
GOLDEN: dict[str, tuple[Query, str]] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Register a function as a query under its name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def golden(sql: str) -> Callable[[Query], Query]:
    """Register a function as worked cases under its name, with their SQL."""

    def register(f: Query) -> Query:
        GOLDEN[f.__name__] = f, sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows of few bytes and much work, dealt over tasks by number: else an adaptive plan joins the partitions of so small
    a shuffle, or a file is read by one task, and few tasks have all the work. Rows are dealt by a hash of their own, as
    dealing them by what they are grouped by is left out of the plan."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*by))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word in ASCII letters of the documents, once."""
    found = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word"))
    return dealt(found.distinct(), "word")


def values(rows: list[tuple], columns: str) -> str:
    """A VALUES list for an oracle, from the rows that the query uses."""

    def one(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, list | tuple):
            return "[" + ", ".join(map(one, x)) + "]"
        return str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS t({columns})"


from kavyamill.plans import corpus, meter, naming, prosody, report, rounds, scripts, stanzas, syllables, text, timeline, units, verse  # noqa: E402, F401  each registers its queries
