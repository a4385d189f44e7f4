"""Candidate pairs from band buckets, and the classes that verified pairs form.

Bucket entries travel as packed arrays, one row for each block and slot of the key space. A block that holds several
entries of a bucket links them to the least of them right there and sends only that one on; the reader of a slot
does the same with what the blocks have sent. So a bucket with very many members adds one entry a block to one task,
and its first pairs are as many as its members, not their square. Such stars miss links, as similarity is not
transitive: where one of a bucket's pairs isn't similar, second_links() compares all of its members that stand apart
with all others, exactly and in pieces of a bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kavyamill.llm.common import in_arrow, mix, regathered
from kavyamill.llm.graph import connected_components

#: Entries that are packed at once, and bytes of packed entries that a reader of slots takes at once, whole slots each time.
ENTRIES, SLOT_BYTES = 1 << 19, 1 << 23
#: Members of a bucket, and bytes of their texts, that make one of the pieces two of which meet in a task.
PIECE, PIECE_BYTES = 512, 1 << 22
#: Elements that are counted at once.
COLUMNS = 4096
#: Groups of up to so many members are compared together, so many bytes of rows at once.
SMALL, SMALL_BYTES = 32, 1 << 18


class Kernel(Protocol):
    """What second_links() needs of an operator."""

    def elements(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text of each element of the texts' sets, text by text: similarity is their Jaccard similarity."""
        ...

PACKED = pa.schema([("slot", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary())])
PACKED_DDL = "slot int, keys binary, ids binary"
_ROWS = pa.schema([("bucket", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def star(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by bucket and id, the first of each bucket, and for each place that of its bucket's first."""
    order = np.argsort(key)
    sorted_key = key[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])) if len(order) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(order)))
    several = np.repeat(size > 1, size)  # most buckets hold one entry, so few places are left to be sorted by id
    some = order[several]
    order[several] = some[np.lexsort((ids[some], key[some]))]
    return order, first, np.repeat(first, size)


def stable_order(values: np.ndarray) -> np.ndarray:
    """As a stable argsort of integers, by two fast sorts: of the values, then of the places within equal ones."""
    if not len(values):
        return np.zeros(0, np.int64)
    order = np.argsort(values)
    ordered = values[order]
    run = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    return np.sort(run * len(values) + order) % len(values)


def slots_for(df: DataFrame) -> int:
    """Several slots for each partition that reads them."""
    return max(1024, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bucket_of(key: np.ndarray, slots: int) -> np.ndarray:
    return (key >> np.uint64(32)) * np.uint64(slots) + key % np.uint64(slots)


def packed(blocks: Iterator[tuple[np.ndarray, np.ndarray]], slots: int) -> Iterator[pa.RecordBatch]:
    """Packed rows of (ids, buckets) of many blocks, some of them taken together."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for ids, buckets in blocks:
        held.append((ids, buckets))
        size += buckets.size
        if size >= ENTRIES:
            yield from pack(*(np.concatenate(x) for x in zip(*held, strict=True)), slots)
            held, size = [], 0
    if held:
        yield from pack(*(np.concatenate(x) for x in zip(*held, strict=True)), slots)


def pack(ids: np.ndarray, buckets: np.ndarray, slots: int) -> Iterator[pa.RecordBatch]:
    """Rows of a block: ids[i] is in each bucket of buckets[i]. A slot below 0 has (bucket, least id, id) found here."""
    if not len(ids):
        return
    key, who = bucket_of(buckets.ravel(), slots), np.repeat(ids.astype(np.int64), buckets.shape[1])
    order, first, lead = star(key, who)
    key, who = key[order], who[order]
    tail = who != who[lead]
    found = np.stack([key[tail].view(np.int64), who[lead][tail], who[tail]], 1)
    key, who = key[first], who[first]
    slot = (key % np.uint64(slots)).astype(np.int32)
    order = np.argsort(slot, kind="stable")
    slot, key, who = slot[order], (key[order] // np.uint64(slots)).astype("<u4"), who[order]
    cuts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1], [True]]))
    names = slot[cuts[:-1]].tolist()
    keys, whos = [key[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], [who[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for at in range(0, len(found), 4096):
        part = found[at : at + 4096]
        names.append(-1 - (at // 4096 + int(ids[0])) % slots)
        keys.append(part[:, 0].tobytes())
        whos.append(part[:, 1:].tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(keys, pa.binary()), pa.array(whos, pa.binary())], schema=PACKED)


def _packed(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The packed values of all rows, one after another, and how many each row has."""
    column = column.cast(pa.large_binary()).combine_chunks()
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, kind), np.zeros(len(column), np.int64)
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].copy().view(kind), np.diff(bounds) // np.dtype(kind).itemsize


def shared_buckets(packed: DataFrame) -> DataFrame:
    """(bucket, a, b) for each member b of a bucket but its least, a being the least of the bucket, or of its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in regathered(batches, 1, SLOT_BYTES):
            slot = table["slot"].to_numpy()
            found, rest = table.filter(pa.array(slot < 0)), table.filter(pa.array(slot >= 0))
            yield from rows(_packed(found["keys"], "<i8")[0], *_packed(found["ids"], "<i8")[0].reshape(-1, 2).T)
            key, n = _packed(rest["keys"], "<u4")
            ids, _ = _packed(rest["ids"], "<i8")
            key = key.astype(np.uint64) * np.uint64(slots) + np.repeat(slot[slot >= 0].astype(np.uint64), n)
            order, _, lead = star(key, ids)
            key, ids = key[order], ids[order]
            tail = ids != ids[lead]
            yield from rows(key[tail].view(np.int64), ids[lead][tail], ids[tail])

    def rows(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(columns[0]), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[at : at + 65536])) for x in columns], schema=_ROWS)

    slots, n = slots_for(packed), int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_arrow(packed.repartition(n, "slot").sortWithinPartitions("slot"), run, "bucket long, a long, b long")


def classes(links: DataFrame) -> DataFrame:
    """(id, component) of the verified links' ends."""
    return connected_components(links, "a", "b")


def similar_pairs(h: np.ndarray, owner: np.ndarray, rows: np.ndarray, n: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i of rows and j of all n sets, whose Jaccard similarity is `least` or more; h and owner list the sets'
    elements, owners ascending. Shared elements are counted for all pairs at once, by products of 0-1 matrices."""
    if not len(h):
        return
    order = stable_order(h)
    h, owner = h[order], owner[order]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[once], owner[once]
    size = np.bincount(owner, minlength=n)
    element = np.cumsum(np.concatenate([[False], h[1:] != h[:-1]]))
    wanted = np.zeros(n, bool)
    wanted[rows] = True
    several = (np.bincount(element) > 1) & (np.bincount(element, wanted[owner]) > 0)
    kept = several[element]
    element, owner = (np.cumsum(several) - 1)[element[kept]], owner[kept]
    for at in range(0, len(rows), PIECE):
        some = rows[at : at + PIECE]
        both = np.zeros((len(some), n), np.float32)
        for first in range(0, int(several.sum()), COLUMNS):
            i, j = np.searchsorted(element, [first, first + COLUMNS])
            holds = np.zeros((n, min(COLUMNS, int(several.sum()) - first)), np.float32)
            holds[owner[i:j], element[i:j] - first] = 1
            both += holds[some] @ holds.T
        either = size[some][:, None] + size[None, :] - both
        left, right = np.nonzero((both >= least * either) & (either > 0))
        yield some[left], right


def similar_in_groups(h: np.ndarray, owner: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of sets of one group whose Jaccard similarity is `least` or more; group g has sets starts[g] to
    starts[g] + sizes[g], owners ascend. For many small groups: shared elements are counted in a square for each group."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    h = h ^ mix(of[owner].astype(np.uint64) + np.uint64(1))
    order = stable_order(h)
    h, owner = h[order], owner[order].astype(np.int64)
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[once], owner[once]
    n = np.bincount(owner, minlength=len(of))
    base = np.cumsum(sizes * sizes) - sizes * sizes
    cell = base[of] + (np.arange(len(of)) - starts[of]) * sizes[of]  # where a set's row in its group's square begins
    both = np.zeros(int((sizes * sizes).sum()), np.int64)
    at = np.arange(len(h))
    for apart in range(1, int(sizes.max(initial=1))):
        at = at[at + apart < len(h)]
        at = at[h[at] == h[at + apart]]
        if not len(at):
            break
        i, j = owner[at], owner[at + apart]
        both += np.bincount(cell[i] + j - starts[of[j]], minlength=len(both))
    found = np.flatnonzero(both)
    g = np.searchsorted(base, found, side="right") - 1
    i, j = starts[g] + (found - base[g]) // sizes[g], starts[g] + (found - base[g]) % sizes[g]
    good = both[found] >= least * (n[i] + n[j] - both[found])
    return i[good], j[good]


def second_links(shared: DataFrame, links: DataFrame, texts: DataFrame, kernel: Kernel, least: float) -> DataFrame:
    """Verified (a, b) between members of a bucket of three or more that not all of the links join to its least.

    A bucket of more than PIECE members, or PIECE_BYTES of text, is cut into groups, and each two groups meet in a task of
    their own, so that a task holds two pieces at most (or two texts that are larger). There, all members but those of the
    largest class are compared with all others, exactly; links that join nothing new are left out.
    """
    known = shared.join(links.select("a", "b", F.lit(True).alias("ok")), ["a", "b"], "left")
    mixed = known.groupBy("bucket").agg(F.max(F.col("ok").isNull()).alias("apart"), F.count("*").alias("n")).where("apart and n > 1").select("bucket")
    members = known.join(mixed, "bucket").select("bucket", F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("a").alias("label")), F.struct(F.col("b").alias("id"), F.when(F.col("ok"), F.col("a")).otherwise(F.col("b")).alias("label")))).alias("x"))
    members = members.groupBy("bucket", "x.id").agg(F.min("x.label").alias("label"))
    sized = members.join(texts.select("id", F.octet_length("text").alias("size")), "id")
    groups = sized.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / PIECE, F.sum("size") / PIECE_BYTES)).cast("int").alias("groups"))
    rows = members.join(groups, "bucket").withColumn("group", F.pmod(F.xxhash64("id"), "groups").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    rows = rows.select("bucket", F.least("group", "other").alias("g1"), F.greatest("group", "other").alias("g2"), "id", "label", "group")
    rows = rows.join(texts.select("id", "text"), "id").select("bucket", "g1", "g2", "id", "label", "group", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in regathered(batches, 3, SMALL_BYTES):
            key = np.stack([table[c].to_numpy() for c in ("bucket", "g1", "g2")])
            begins = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
            sizes = np.diff(np.append(begins, table.num_rows))
            small = sizes <= SMALL
            for at, n in zip(begins[~small], sizes[~small], strict=True):
                yield from compare(table.slice(at, n))
            if small.any():
                yield from compare_small(table.filter(pa.array(np.repeat(small, sizes))), sizes[small])

    def compare_small(t: pa.Table, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """As compare(), of many groups: their texts' elements are found and counted together."""
        ids, labels, group = t["id"].to_numpy(), t["label"].to_numpy(), t["group"].to_numpy()
        starts = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(sizes)), sizes)
        cross = (t["g1"].to_numpy() != t["g2"].to_numpy())
        left, right = similar_in_groups(*kernel.elements(t["text"].to_pylist()), starts, sizes, least)
        new = (labels[left] != labels[right]) & (~cross[left] | (group[left] != group[right]))
        found, roots = [], {}

        def top(x: tuple[int, int]) -> tuple[int, int]:
            while x in roots:
                x = roots[x]
            return x

        asked = set(of[left[new]].tolist())
        for g, x, y in zip(of.tolist(), ids.tolist(), labels.tolist(), strict=True):
            if g in asked and (a := top((g, x))) != (b := top((g, y))):
                roots[a] = b
        for i, j in zip(left[new].tolist(), right[new].tolist(), strict=True):
            if (a := top((of[i], ids[i]))) != (b := top((of[j], ids[j]))):
                roots[a] = b
                found.append((ids[i], ids[j]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f(x) for x in found], pa.int64()) for f in (min, max)], schema=_PAIRS)

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, group, n = t["id"].to_numpy(), t["group"].to_numpy(), t.num_rows
        _, at = np.unique(np.concatenate([ids, t["label"].to_numpy()]), return_inverse=True)
        root = np.arange(int(at.max()) + 1)

        def join(x: int, y: int) -> bool:
            x, y = root[x], root[y]
            if x != y:
                root[root == x] = y
            return x != y

        for x, y in zip(at[:n], at[n:], strict=True):
            join(x, y)
        label = root[at[:n]]
        cross = t["g1"][0].as_py() != t["g2"][0].as_py()
        rest = np.flatnonzero(label != np.argmax(np.bincount(label)))
        if not len(rest):
            return
        found = []
        for left, right in similar_pairs(*kernel.elements(t["text"].to_pylist()), rest, n, least):
            new = (label[left] != label[right]) & ((group[left] != group[right]) if cross else True)
            found += [(ids[i], ids[j]) for i, j in zip(left[new], right[new], strict=True) if join(at[i], at[j])]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f(x) for x in found], pa.int64()) for f in (min, max)], schema=_PAIRS)

    n = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "bucket", "g1", "g2").sortWithinPartitions("bucket", "g1", "g2", "id")
    return in_arrow(dealt, run, "a long, b long")
