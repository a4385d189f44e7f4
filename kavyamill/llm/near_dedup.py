"""MinHash near-dedup with DartMinHash: weighted five-word shingles, banded signatures, exact verification.

Each unit of an element's weight is a region at which darts are thrown, their ranks a Poisson process that depends
on the element and the unit alone. A signature keeps the dart of least rank in each coordinate; ranks are made only
as far as needed to fill all coordinates. Two texts share a coordinate with the probability of their weighted
Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kavyamill.llm.banding import PACKED_DDL, classes, packed, second_links, shared_buckets, slots_for
from kavyamill.llm.common import Texts, checkpointed, cuts, in_arrow, mix, shingle_hashes, text_blocks

SHINGLE, SIMILARITY = 5, 0.8
#: A pair at SIMILARITY meets in no band with probability (1 - 0.8 ** ROWS) ** BANDS, below 1e-4.
BANDS, ROWS = 24, 5

_ARRIVAL, _PLACE, _UNIT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def elements(t: Texts, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each k-word shingle; a text of fewer words has one, of all its words."""
    start, end, text = t.words()
    word = t.hashes(start, end)
    shingles, at = shingle_hashes(word, text, k)
    n = np.bincount(text, minlength=t.n)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        first = np.searchsorted(text, short)
        whole = np.array([mix(np.add.reduce(word[f : f + m] * (np.arange(1, m + 1, dtype=np.uint64) * _UNIT), keepdims=True))[0] for f, m in zip(first, n[short], strict=True)], np.uint64)
        return np.concatenate([shingles, whole]), np.concatenate([text[at], short])
    return shingles, text[at]


def regions(shingle: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A hash for each unit of weight: the shingle and how many equal ones come before it in the text."""
    key = shingle ^ mix(text.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, bool)
    begins = np.flatnonzero(new)
    before = np.empty(len(key), np.uint64)
    before[order] = np.arange(len(key)) - np.repeat(begins, np.diff(np.append(begins, len(key))))
    return mix(shingle + before * _UNIT)


def dart_minhash(region: np.ndarray, text: np.ndarray, n: int, size: int = BANDS * ROWS) -> np.ndarray:
    """Least rank in each coordinate, for each of n texts; infinite for a text without weight."""
    out = np.full((n, size), np.inf)
    weight = np.bincount(text, minlength=n)
    reach = size * (np.log(size) + 5.0) / np.maximum(weight, 1)
    open_texts = weight > 0
    while open_texts.any():
        here = open_texts[text]
        cell, owner, rank = region[here], text[here], np.zeros(int(here.sum()))
        step, chunk = 1, 1
        while len(cell):
            turn = np.arange(step, step + chunk, dtype=np.uint64)
            wait = -np.log(((mix(cell[:, None] + turn * _ARRIVAL) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53)
            wait[:, 0] += rank
            ranks = np.cumsum(wait, axis=1)
            hit = ranks <= reach[owner][:, None]
            place = (mix(cell[:, None] + turn * _PLACE) % np.uint64(size)).astype(np.int64)
            np.minimum.at(out.reshape(-1), (owner[:, None] * size + place)[hit], ranks[hit])
            alive = hit[:, -1]
            cell, owner, rank = cell[alive], owner[alive], ranks[alive, -1]
            step += chunk
            chunk = 64 if step > 8 and len(cell) < 4096 else 1
        open_texts &= np.isinf(out).any(1)
        reach = np.where(open_texts, 2 * reach, reach)
    return out


def buckets(signature: np.ndarray) -> np.ndarray:
    """A hash for each band."""
    values = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    h = np.zeros((len(signature), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _UNIT
    for j in range(ROWS):
        h = mix(h * _ARRIVAL + values[:, :, j])
    return h


def similarities(t: Texts) -> np.ndarray:
    """Weighted Jaccard of texts 0 and 1, 2 and 3, and so on; 0 where both are without words."""
    shingle, text = elements(t)
    pair, side = text // 2, text % 2
    key = shingle ^ mix(pair.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    key, pair, side = key[order], pair[order], side[order]
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    if not len(begins):
        return np.zeros(t.n // 2)
    ones = np.add.reduceat(side, begins)
    zeros = np.diff(np.append(begins, len(key))) - ones
    shared = np.bincount(pair[begins], np.minimum(ones, zeros), t.n // 2)
    whole = np.bincount(pair[begins], np.maximum(ones, zeros), t.n // 2)
    return shared / np.maximum(whole, 1)


class Kernel:
    """The weight units of texts' shingles, for the second comparison."""

    def elements(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        shingle, text = elements(Texts.of(texts))
        order = np.argsort(text, kind="stable")
        return regions(shingle, text)[order], text[order]


def signatures(docs: DataFrame) -> DataFrame:
    """Packed bucket entries of (id, text)."""

    slots = slots_for(docs)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, to, t in text_blocks(batch):
                shingle, text = elements(t)
                has = np.bincount(text, minlength=t.n) > 0
                yield ids[at:to][has], buckets(dart_minhash(regions(shingle, text), text, t.n)[has])

    return in_arrow(docs, lambda batches: packed(blocks(batches), slots), PACKED_DDL)


def verified(pairs: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of ids whose texts are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for at, to in cuts([len(x) + len(y) for x, y in zip(left, right, strict=True)], 1 << 20):
                good = pa.array(similarities(Texts.of([x for pair in zip(left[at:to], right[at:to], strict=True) for x in pair])) >= least)
                yield batch.slice(at, to - at).select([0, 1]).filter(good)

    left = pairs.join(docs.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    full = left.join(docs.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return in_arrow(full.select("a", "b", "text_a", "text_b"), run, "a long, b long")


def text_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [None if x is None else xxhash.xxh3_128_digest(x.encode()) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], names=["doc_id", "key"])


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) of every document: class_id is the least doc_id that equal or similar texts lead to.

    Texts are similar if the weighted Jaccard similarity of their five-word shingles, weighted by how often each
    occurs, is `least` or more. Words are runs without whitespace; a text of fewer than five words is one shingle; texts
    without words, empty ones included, are alike only if equal; a null text is alone. Repeated rows, and rows with
    the same doc_id, count as one document. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = checkpointed(in_arrow(rows, text_key, "doc_id long, key binary").groupBy("doc_id").agg(F.min("key").alias("key")))
    copies = keys.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("id"))
    texts = rows.select(F.col("doc_id").alias("id"), "text").where("id is not null and text is not null")
    first = keys.join(copies, "key").select("doc_id", "id")  # copies meet the same partners: only the first is compared
    shared = shared_buckets(signatures(texts))
    shared = shared.join(first.select(F.col("doc_id").alias("a"), F.col("id").alias("x")), "a").join(first.select(F.col("doc_id").alias("b"), F.col("id").alias("y")), "b")
    shared = checkpointed(shared.select("bucket", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct())
    links = checkpointed(verified(shared.select("a", "b").distinct(), texts, least))
    links = links.unionByName(second_links(shared, links, texts, Kernel(), least))
    copied = keys.join(copies, "key").where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    found = classes(links.unionByName(copied))
    joined = keys.select("doc_id").join(found, keys.doc_id == found.id, "left")
    return joined.select("doc_id", F.coalesce("component", "doc_id").alias("class_id"))
