"""Scans and sinks of the corpus formats, as Spark readers and writers."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

Schema = StructType | str


def json_array(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """A file that is one array of objects."""
    return spark.read.schema(schema).json(path, multiLine=True)


def json_map(spark: SparkSession, path: str, value_schema: str, key: str = "key") -> DataFrame:
    """A file that is one object, a row for each key whose value is an object; a broken file gives no rows."""
    whole = spark.read.text(path, wholetext=True)
    parsed = whole.select(F.explode(F.from_json("value", f"map<string,{value_schema}>")).alias(key, "v"))
    return parsed.where("v is not null").select(key, "v.*")


def json_lines(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """One object a line; blank lines are skipped, broken ones kept in _corrupt_record if the schema has it."""
    return spark.read.schema(schema).json(path)


def pipe_csv(spark: SparkSession, path: str, casts: dict[str, str] | None = None) -> DataFrame:
    """A |-separated file with a header; all strings but for the casts, which give null where they fail."""
    rows = spark.read.option("sep", "|").option("header", True).csv(path)
    return rows.withColumns({c: F.expr(f"try_cast(`{c}` as {t})") for c, t in (casts or {}).items()})


def tagged_union(spark: SparkSession, paths: dict[int, str], tag: str, casts: dict[str, str] | None = None) -> DataFrame:
    """Several |-separated files, each with a constant of its own."""
    parts = [pipe_csv(spark, path, casts).withColumn(tag, F.lit(value)) for value, path in paths.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def text_tree(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(path, text) of all matching files below a folder; bytes that are no UTF-8 become the replacement character."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    text = F.decode("content", "UTF-8") if spark.conf.get("spark.sql.legacy.codingErrorAction", "false") == "true" else F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.make_valid_utf8(F.col("content").cast("string")))
    return files.select("path", text.alias("text"), (F.try_validate_utf8(F.col("content").cast("string")).isNull()).alias("was_broken"))


def text_grid(spark: SparkSession, path: str, tier: str = "phones") -> DataFrame:
    """(path, at, start, end, label) of a tier's intervals with a label."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    body = F.regexp_extract("value", rf'(?s)name\s*=\s*"{tier}"(.*?)(?:name\s*=|\z)', 1)
    pattern = r'xmin\s*=\s*([0-9.]+)\s*xmax\s*=\s*([0-9.]+)\s*text\s*=\s*"([^"]*)"'
    parts = F.arrays_zip(*[F.regexp_extract_all(body, F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "s"), (2, "e"), (3, "t"))])
    rows = files.select("path", F.posexplode(parts).alias("at", "x"))
    return rows.select("path", "at", F.col("x.s").cast("double").alias("start"), F.col("x.e").cast("double").alias("end"), F.trim("x.t").alias("label")).where("label <> ''")


def align_units(spark: SparkSession, path: str) -> DataFrame:
    """An alignment file's units, exploded, with the total length on each."""
    schema = "total_dur double, units array<struct<fn:string,v:int,p:string,start:double,end:double,nchars:int>>"
    return spark.read.schema(schema).json(path, multiLine=True).select("total_dur", F.posexplode("units").alias("at", "u")).select("total_dur", "at", "u.*")


def existing(rows: DataFrame, listing: DataFrame, name: str) -> DataFrame:
    """Rows whose file a binaryFile listing has (only its path column is read)."""
    names = listing.select(F.regexp_extract("path", r"([^/]+)$", 1).alias(name)).distinct()
    return rows.join(names, name, "left_semi")


def wav_header(listing: DataFrame) -> DataFrame:
    """(path, channels, rate, bits, seconds) of PCM files, read from the first 44 bytes in the JVM."""
    le = lambda at, n: F.conv(F.hex(F.reverse(F.substring("content", at, n))), 16, 10).cast("long")
    head = listing.where(F.decode(F.substring("content", 1, 4), "US-ASCII") == "RIFF")
    rows = head.select("path", le(23, 2).alias("channels"), le(25, 4).alias("rate"), le(35, 2).alias("bits"), le(41, 4).alias("bytes"))
    return rows.select("path", "channels", "rate", "bits", (F.col("bytes") / (F.col("rate") * F.col("channels") * F.col("bits") / 8)).alias("seconds"))


@F.pandas_udf(ArrayType(LongType()))
def _int_vector(contents: pd.Series) -> pd.Series:
    def one(content: bytes | None) -> np.ndarray | None:
        try:
            vector = np.load(io.BytesIO(content or b""), allow_pickle=False)
        except (ValueError, EOFError):
            return None
        return vector.astype(np.int64) if isinstance(vector, np.ndarray) and vector.ndim == 1 and vector.dtype.kind in "iu" else None

    return contents.map(one)


def npy_vectors(listing: DataFrame) -> DataFrame:
    """(path, values, total) of the files of a binaryFile listing; null values where a file isn't a vector of integers."""
    rows = listing.select("path", _int_vector("content").alias("values"))
    return rows.withColumn("total", F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x))


def write_json_array(rows: DataFrame, path: str, order: str) -> None:
    """One array of objects in one file, for manifests that a page or a person reads: bounded by being one file."""
    array = rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct(order, *[c for c in rows.columns if c != order]))), {"ignoreNullFields": "true"}).alias("value"))
    array.coalesce(1).write.mode("overwrite").text(path)


def write_dual(rows: DataFrame, flat: list[str], csv_path: str, json_path: str) -> None:
    """A flat |-separated projection and the full nested rows, both from one computation."""
    kept = rows.persist()
    try:
        kept.select(*flat).write.mode("overwrite").option("sep", "|").option("header", True).csv(csv_path)
        kept.write.mode("overwrite").option("ignoreNullFields", False).json(json_path)
    finally:
        kept.unpersist()


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_rotated(rows: DataFrame, path: str, most_records: int) -> None:
    """Files of at most so many records."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", most_records).parquet(path)


def write_by(rows: DataFrame, by: str, path: str) -> None:
    """A folder for each value."""
    rows.repartition(by).write.mode("overwrite").partitionBy(by).json(path)


def not_yet_written(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose output is not there: reruns take up where they stopped."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def packaged_path(chapter: Column, filename: Column) -> Column:
    """chNN_ before a file's name."""
    return F.format_string("ch%02d_%s", chapter, filename)
