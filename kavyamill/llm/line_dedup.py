"""Line dedup: fuzzy lines by MinHash over character shingles, exact Jaccard, one line kept of each component."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kavyamill.llm.banding import PACKED_DDL, classes, packed, second_links, shared_buckets, slots_for
from kavyamill.llm.common import checkpointed, cuts, in_arrow, mix, unused, written

#: Characters of a shingle, least Jaccard similarity, and least characters of a compared line unless the caller sets it.
SHINGLE, SIMILARITY, MIN_CHARS = 8, 0.8, 24
#: A pair at SIMILARITY meets in no band with probability (1 - 0.8 ** ROWS) ** BANDS, about 2e-4.
BANDS, ROWS = 16, 4
BINS = BANDS * ROWS
#: Characters of lines that are worked on at once.
BLOCK = 1 << 18

_STEP = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(2**64 - 1)
_BIN_SHIFT = np.uint64(64 - (BINS - 1).bit_length())


def compared(line: str, shortest: int = MIN_CHARS) -> bool:
    return len(line) >= max(shortest, 1) and not line.isspace()


def line_id(line: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(line.encode()), "big", signed=True)


def shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and line of each character shingle; each line has SHINGLE characters or more."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4").astype(np.uint64)
    h, width = codes, 1
    while width < SHINGLE:  # hashes of neighbouring stretches make that of the two
        left = h[:-width] * np.uint64(pow(int(_STEP), width, 1 << 64))
        left += h[width:]
        h, width = left, 2 * width
    end = np.cumsum([len(x) for x in lines])
    owner = np.repeat(np.arange(len(lines), dtype=np.int32), np.diff(end, prepend=0))[: len(h)]
    inside = np.ones(len(h), bool)
    for j in range(1, SHINGLE):
        inside[end[:-1] - j] = False
    return mix(h[inside]), owner[inside]


def signatures(lines: list[str]) -> np.ndarray:
    """One-permutation MinHash: the least hash in each bin; an empty bin borrows from one that its number leads to."""
    h, owner = shingles(lines)
    out = np.full(len(lines) * BINS, _NONE)
    np.minimum.at(out, owner.astype(np.int64) * BINS + (h >> _BIN_SHIFT).astype(np.int64), h)
    out = out.reshape(-1, BINS)
    row, col = np.nonzero(out == _NONE)
    donor, turn = out.copy(), 0
    while len(row):
        turn += 1
        value = donor[row, _donors(turn)[col]]
        found = value != _NONE
        out[row[found], col[found]] = mix(value[found] + np.uint64(turn))
        row, col = row[~found], col[~found]
    return out


@cache
def _donors(turn: int) -> np.ndarray:
    return (mix(np.arange(BINS, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(turn)) % np.uint64(BINS)).astype(np.int64)


def buckets(signature: np.ndarray) -> np.ndarray:
    values = signature.reshape(len(signature), BANDS, ROWS)
    h = np.zeros((len(signature), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP
    for j in range(ROWS):
        h = mix(h * _STEP + values[:, :, j])
    return h


def similarities(left: list[str], right: list[str]) -> np.ndarray:
    """Jaccard of the shingle sets of each pair of lines."""
    lines = [x for pair in zip(left, right, strict=True) for x in pair]
    h, owner = shingles(lines)
    pair, side = owner // 2, owner % 2
    key = h ^ mix(pair.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    key, pair, side = key[order], pair[order], side[order]
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    if not len(begins):
        return np.zeros(len(left))
    either = np.bincount(pair[begins], minlength=len(left))
    ones = np.add.reduceat(side, begins)
    both = (ones > 0) & (ones < np.diff(np.append(begins, len(key))))
    return np.bincount(pair[begins], both, len(left)) / np.maximum(either, 1)


class Kernel:
    """The shingle sets of lines, for the second comparison."""

    def elements(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return shingles(texts)


def occurrences(docs: DataFrame, shortest: int = MIN_CHARS) -> DataFrame:
    """(doc_id, line_no, line) of each line that is compared, line being its id."""
    schema = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32()), ("line", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [(d, n, line_id(x)) for d, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for n, x in enumerate((text or "").split("\n")) if compared(x, shortest)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, line_no int, line long")


def line_buckets(docs: DataFrame, shortest: int = MIN_CHARS) -> DataFrame:
    """Packed bucket entries of the distinct lines of each block; a line below SHINGLE characters is its only shingle
    and like none but its copies, so it needs none."""
    shortest = max(shortest, SHINGLE)
    slots = slots_for(docs)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lines: dict[str, None] = {}
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(at, 256).to_pylist():
                    for line in (text or "").split("\n"):
                        if compared(line, shortest) and line not in lines:
                            lines[line] = None
                            size += len(line)
                            if size >= BLOCK:
                                yield entries(list(lines))
                                lines, size = {}, 0
        if lines:
            yield entries(list(lines))

    def entries(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([line_id(x) for x in lines]), buckets(signatures(lines))

    return in_arrow(docs.select("text"), lambda batches: packed(blocks(batches), slots), PACKED_DDL)


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, text): the text of each wanted (doc_id, line_no, line)."""
    listed = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "line")).alias("wanted"))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(listed, "doc_id").select("text", "wanted")
    lines = joined.select(F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w"))
    return lines.select("w.line", F.get("lines", F.col("w.line_no")).alias("text"))


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for at, to in cuts([len(x) + len(y) for x, y in zip(left, right, strict=True)], BLOCK):
                yield batch.slice(at, to - at).select([0, 1]).filter(pa.array(similarities(left[at:to], right[at:to]) >= least))

    left = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    full = left.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return in_arrow(full.select("a", "b", "text_a", "text_b"), run, "a long, b long")


def removed_lines(docs: DataFrame, least: float = SIMILARITY, shortest: int = MIN_CHARS) -> DataFrame:
    """(doc_id, line_no, class_line) of each line that goes: all of a component but its first, by doc_id and line_no."""
    rows = written(occurrences(docs, shortest))
    shared = checkpointed(shared_buckets(line_buckets(docs, shortest)))
    pairs = shared.select("a", "b").distinct()
    ends = pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct().withColumn("met", F.lit(True))
    # Most lines occur once and meet no other: all that follows needs the rest alone.
    lines = rows.groupBy("line").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n"))
    lines = checkpointed(lines.join(ends, "line", "left").where("n > 1 or met"))
    texts = checkpointed(line_texts(docs, lines.where("met").select("first.doc_id", "first.line_no", "line")).dropDuplicates(["line"]).withColumnRenamed("line", "id"))
    links = checkpointed(verified(pairs, texts, least))
    found = classes(links.unionByName(second_links(shared, links, texts, Kernel(), least)))
    named = lines.join(found.withColumnRenamed("id", "line"), "line", "left").where("n > 1 or component is not null")
    named = named.withColumn("class_line", F.coalesce("component", "line"))
    heads = named.groupBy("class_line").agg(F.min("first").alias("head"))
    fates = named.select("line", "class_line").join(heads, "class_line")
    return rows.join(fates, "line").where((F.col("doc_id") != F.col("head.doc_id")) | (F.col("line_no") != F.col("head.line_no"))).select("doc_id", "line_no", "class_line")


def dedup_lines(docs: DataFrame, least: float = SIMILARITY, shortest: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed): removed holds the numbers of the lines that go, in order, from 0.

    Lines end at \\n. Those of `shortest` characters or more with a visible one are compared over all documents; equal
    lines, and lines whose sets of character shingles have Jaccard similarity `least` or more, form components, also by
    way of others, and each component keeps its first line by doc_id and line number. Shorter and blank lines stay. A
    line below SHINGLE characters is one shingle.
    Null texts have no line, empty ones have one, blank. Rows with the same doc_id are one document for the line
    numbers to go; each row gives a row. Other columns are ignored.
    """
    gone = removed_lines(docs, least, shortest).groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    joined = rows.withColumn("n_lines", F.greatest("n_lines", F.lit(0))).join(gone, "doc_id", "left")
    return joined.select("doc_id", "n_lines", F.greatest(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), "removed")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs with the lines of `gone` (doc_id, line_no) taken out of their texts; its columns stay."""
    lines, ident = unused(docs, "_gone"), unused(docs, "_gone_id")
    listed = gone.groupBy(F.col("doc_id").alias(ident)).agg(F.collect_set("line_no").alias(lines))
    joined = docs.join(listed, F.col("doc_id") == F.col(ident), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(lines, i)), "\n")
    return joined.withColumn("text", F.when(F.col(lines).isNull(), F.col("text")).otherwise(kept)).drop(lines, ident)
