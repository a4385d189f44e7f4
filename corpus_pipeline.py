"""From raw documents to tokens: five stages, each of which takes what the one before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kavyamill.llm import byte_bpe, decontaminate, line_dedup, near_dedup, quality_classifier
from kavyamill.llm.common import checkpointed, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance classifier keeps.

    Rows without a word or mark (null, empty and blank texts) go; repeated rows, and ties at the border, share one fate;
    texts are weighed whole. Without a good label all others stay. Columns stay as they are, whatever their names.
    """
    return quality_classifier.select_good(docs, table(spark, sf_dir, "labels")).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat others' lines; those with no visible line left go.

    Of equal or similar lines the first stays, by doc_id and line number; rows with the same doc_id lose the same line
    numbers. Null, empty and blank texts go. n_chars, where there is one, follows the text; other columns stay.
    """
    out = line_dedup.without(docs, line_dedup.removed_lines(docs, shortest=1))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.where(F.col("text").rlike(r"\S")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near copies.

    Repeated rows become one; of rows with one doc_id and different texts all stay or go together. Texts without words
    are copies only of equal ones; null texts are copies of none. Texts are compared whole; columns stay.
    """
    copies = near_dedup.near_duplicates(docs).where("doc_id <> class_id").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    An item is held where 0.8 of its template's windows are, with one value for each slot value, in any of three
    readings. Rows with one doc_id go together, repeated rows too. Null, empty and short texts hold nothing and stay.
    """
    leaks = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).where("leak").select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes that they decode to; a row for each row, null as empty."""
    return byte_bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks), ("tokens", tokens)]

#: Models, signatures and tokens are beyond SQL: tests hold the operators that the stages call against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
