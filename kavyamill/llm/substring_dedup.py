"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere are removed.

Two equal strings of LENGTH bytes hold the same bytes at the same place where the hash of GRAM bytes is least, so
only those places (anchors) travel. Anchors whose whole surroundings recur are settled by that. For the others, the
suffixes that begin at equal anchors are sorted by a mergesort that compares two suffixes by their common extension,
found by binary search on prefix polynomial hashes and checked by the bytes; neighbours in the sorted order, and in
that of the bytes to the left, tell which strings recur. An anchor with very many different surroundings is taken apart
first: by more and more of the bytes around it, until few enough contexts hold the same ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kavyamill.llm.common import Texts, _powers, checkpointed, in_arrow, mix, regathered, text_blocks, written

LENGTH, GRAM = 400, 200
REACH = LENGTH - GRAM
HALF = REACH // 2
SLOTS = 1 << 12
#: Bytes of text whose anchors are packed at once.
PACKED = 1 << 20
#: Bytes of packed anchors that a reader of slots takes at once, whole slots each time.
SLOT_BYTES = 1 << 23
#: Bits for a place within a block of texts; longer texts are cut into pieces that overlap by LENGTH - 1 bytes.
PLACE_BITS = 22
PIECE = 1 << 21
#: Contexts that are sorted at once, unless more hold the same bytes on one side of their anchors.
CONTEXTS = 4096
#: Different contexts of an anchor beyond which they are taken apart before they are compared.
CROWD = 512

_C = np.uint64(0xD6E8FEB86659FD93)
_FOUND = "k long, kind int, h long, place int, till int"
_FOUND_SCHEMA = pa.schema([("k", pa.int64()), ("kind", pa.int32()), ("h", pa.int64()), ("place", pa.int32()), ("till", pa.int32())])
_NODES = "part long, k long, place int, lo int, hi int, settled int, before int, bytes binary"
_NODES_SCHEMA = pa.schema([("part", pa.int64()), ("k", pa.int64()), *((x, pa.int32()) for x in ("place", "lo", "hi", "settled", "before")), ("bytes", pa.binary())])
#: Kinds of a found row: strings from place to till recur; the anchor's context is asked for; anchors of this hash are a crowd.
RECUR, ASK, CROWDED = 0, 1, 2


def _window_hashes(t: Texts, n: int) -> np.ndarray:
    p = t.prefix()
    _, down = _powers(len(t.data) + 1)
    return mix((p[n:] - p[:-n]) * down[: len(t.data) - n + 1])


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    rows = -(-len(x) // w)
    padded = np.full(rows * w, np.uint64(2**64 - 1))
    padded[: len(x)] = x
    padded = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: len(x) - w + 1], ahead[w - 1 : len(x)])


def _common(p: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the longest common extension to the right of places a and b, at most `most`, by binary search."""
    low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = (p[a + middle] - p[a]) * down[a] == (p[b + middle] - p[b]) * down[b]
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def _common_left(p: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = (p[a] - p[a - middle]) * down[a - middle] == (p[b] - p[b - middle]) * down[b - middle]
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def block_anchors(t: Texts) -> tuple[np.ndarray, ...] | None:
    """Anchors of a block: hash, hash of the whole context or 0, text, place, whether all of it recurs; and settled runs:
    text, from, to. Settled runs send anchors too, for other texts to be compared with: one for each phase, if it has
    one whose whole context is in the run, else all."""
    n = len(t.data)
    if n < LENGTH:
        return None
    owner = np.repeat(np.arange(t.n), np.diff(t.bounds))
    inside = np.zeros(n - LENGTH + 1, bool)
    inside[:] = owner[: n - LENGTH + 1] == owner[LENGTH - 1 :]
    if not inside.any():
        return None
    h = _window_hashes(t, GRAM)
    place_mask = np.uint64((1 << PLACE_BITS) - 1)
    least = _sliding_least((h & ~place_mask) | np.arange(len(h), dtype=np.uint64), REACH + 1) & place_mask
    least = least.astype(np.int64)
    at = np.unique(least[inside])
    p = t.prefix()
    _, down = _powers(n + 1)
    # Periodic stretches settle themselves: equal anchors near each other show the period.
    a, b = at[:-1], at[1:]
    near = (h[a] == h[b]) & (b - a <= REACH) & (owner[a] == owner[b])
    a, b = a[near], b[near]
    first, last = t.bounds[owner[a]], t.bounds[owner[b] + 1]
    right = _common(p, down, a, b, last - b)
    left = _common_left(p, down, a, b, a - first)
    long = left + right >= LENGTH
    runs = np.unique(np.stack([(a - left)[long], (a + right)[long], (b - a)[long]], 1), axis=0)
    borne_out = np.array([np.array_equal(t.data[i:j], t.data[i + s : j + s]) for i, j, s in runs.tolist()], bool)
    begin, till, shift = runs[borne_out].T
    till = till - LENGTH
    settled = np.zeros(n + 1, np.int64)
    for s in (begin, begin + shift):
        np.add.at(settled, s, 1)
    for s in (till + 1, till + shift + 1):
        np.add.at(settled, s, -1)
    settled = np.cumsum(settled)[: len(inside)] > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (settled & inside).astype(np.int8), [0]])))
    runs = edges[::2], edges[1::2] - 1
    at, known = _with_settled(np.unique(least[inside & ~settled]), h, least, *runs)
    text, start = owner[at], t.bounds[owner[at]]
    whole = (at - REACH >= start) & (at + LENGTH <= t.bounds[text + 1])
    context = np.zeros(len(at), np.uint64)
    w = at[whole]
    context[whole] = mix((p[w + LENGTH] - p[w - REACH]) * down[w - REACH]) | np.uint64(1)
    return h[at], context, text, at - start, known, owner[runs[0]], runs[0] - t.bounds[owner[runs[0]]], runs[1] - t.bounds[owner[runs[0]]]


def _with_settled(at: np.ndarray, h: np.ndarray, least: np.ndarray, begin: np.ndarray, till: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchors `at` and those of the settled runs of starts, in order, and which are known to recur in all offsets."""
    if not len(begin):
        return at, np.zeros(len(at), bool)
    size = till - begin + 1
    run = np.repeat(np.arange(len(begin)), size)
    start = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + begin[run]
    place = least[start]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (run[1:] != run[:-1])])
    place, run = place[new], run[new]
    central = (place - REACH >= begin[run]) & (place <= till[run])
    # A run has one period: a central anchor holds every string of the anchors that are equal to it.
    order = np.lexsort((~central, h[place], run))
    place, run, central = place[order], run[order], central[order]
    first = np.concatenate([[True], (run[1:] != run[:-1]) | (h[place[1:]] != h[place[:-1]])])
    phase = np.cumsum(first) - 1
    sent = first | ~central[first][phase]
    place, central = place[sent], central[sent]
    every = np.union1d(at, place)
    return every, np.isin(every, place[central])


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, Texts]]:
    """Blocks of texts with each one's key and the place where it begins in its document."""
    keys = batch.column(0).to_numpy(zero_copy_only=False)
    for at, to, t in text_blocks(batch, "text", PACKED):
        if len(t.data) <= PIECE:
            yield keys[at:to], np.zeros(to - at, np.int64), t
        else:
            for start in range(0, len(t.data) - LENGTH + 1, PIECE - LENGTH + 1):
                part = t.data[start : start + PIECE]
                yield keys[at:to], np.array([start]), Texts(part, np.array([0, len(part)]))


def anchors(docs: DataFrame) -> DataFrame:
    """Packed anchors by slot; slot -1: settled runs. Of equal contexts in a block one goes on, marked as recurring.

    Contexts of one block are compared by their bytes. Those of different blocks meet by two hashes of 64 bits, the
    polynomial one and one of another kind (proof).
    """
    schema = pa.schema([("slot", pa.int32()), *((x, pa.binary()) for x in ("h", "context", "proof", "k", "place", "twice"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, base, t in _pieces(batch):
                found = block_anchors(t)
                if found is None:
                    continue
                h, context, text, place, known, run_text, run_from, run_to = found
                order = np.lexsort((context, h))
                h, context, text, place, known = h[order], context[order], text[order], place[order], known[order]
                begin = place + t.bounds[text] - REACH
                same = np.zeros(len(h), bool)
                same[1:] = (h[1:] == h[:-1]) & (context[1:] == context[:-1]) & (context[1:] > 0)
                same[same] = _equal_contexts(t.data, begin[np.flatnonzero(same) - 1], begin[same])
                twice = same | known
                twice[:-1] |= same[1:]
                k, place = keys[text], place + base[text]
                rows: list[tuple] = []
                done_k = np.concatenate([keys[run_text], k[same]])
                done_from = np.concatenate([run_from + base[run_text], place[same] - REACH]).astype("<i4")
                done_to = np.concatenate([run_to + base[run_text], place[same]]).astype("<i4")
                for i in range(0, len(done_k), 65536):
                    cut = slice(i, i + 65536)
                    rows.append((-1 - int(done_k[i]) % SLOTS, b"", b"", b"", done_k[cut].astype("<i8").tobytes(), done_from[cut].tobytes(), done_to[cut].tobytes()))
                rest = ~same
                h, context, begin, k, place, twice = h[rest], context[rest], begin[rest], k[rest], place[rest], twice[rest]
                proof, view = np.zeros(len(h), np.uint64), memoryview(t.data)
                whole = context > 0
                proof[whole] = [xxhash.xxh3_64_intdigest(view[i : i + REACH + LENGTH]) for i in begin[whole].tolist()]
                slot = (h % np.uint64(SLOTS)).astype(np.int32)
                order = np.argsort(slot, kind="stable")
                slot, h, context, proof, k, place, twice = (x[order] for x in (slot, h, context, proof, k.astype("<i8"), place.astype("<i4"), twice))
                cuts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1], [True]])) if len(slot) else np.zeros(1, np.int64)
                rows += [(int(slot[i]), *(x[i:j].tobytes() for x in (h, context, proof, k, place, twice))) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return in_arrow(docs.select("k", "text"), run, "slot int, h binary, context binary, proof binary, k binary, place binary, twice binary")


def _equal_contexts(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the contexts that begin at a and at b hold the same bytes."""
    if not len(a):
        return np.zeros(0, bool)
    seen = np.lib.stride_tricks.sliding_window_view(data, REACH + LENGTH)
    return np.concatenate([(seen[a[i : i + 2048]] == seen[b[i : i + 2048]]).all(1) for i in range(0, len(a), 2048)])


def repeated(packed: DataFrame) -> DataFrame:
    """What recurring anchors show (RECUR), and the anchors whose contexts must be compared: each (ASK), or by their hash
    alone, where they have more than CROWD different contexts (CROWDED)."""
    most = CROWD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in regathered(batches, 1, SLOT_BYTES):
            settled = pc.less(table["slot"], 0)
            done, rest = table.filter(settled), table.filter(pc.invert(settled))
            k, place, till = (_joined(done[i], kind) for i, kind in ((4, "<i8"), (5, "<i4"), (6, "<i4")))
            for at in range(0, len(k), 65536):
                cut = slice(at, at + 65536)
                yield _found(k[cut], np.full(len(k[cut]), RECUR), np.zeros(len(k[cut]), np.int64), place[cut], till[cut])
            if rest.num_rows:
                yield from settle(*(_joined(rest[i], kind) for i, kind in enumerate(("<u8", "<u8", "<u8", "<i8", "<i4", "?"), 1)))

    def settle(h: np.ndarray, context: np.ndarray, proof: np.ndarray, k: np.ndarray, place: np.ndarray, twice: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((context, h))
        h, context, proof, k, place, twice = h[order], context[order], proof[order], k[order], place[order], twice[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        group = np.cumsum(new) - 1
        # Where equal contexts have different proofs they stand apart, and are compared by their bytes.
        other = np.concatenate([[True], new[1:] | (context[1:] != context[:-1]) | (proof[1:] != proof[:-1]) | (context[1:] == 0)])
        part = np.cumsum(other) - 1
        full = (np.bincount(part) > 1)[part] | (np.bincount(part, twice) > 0)[part]
        yield _found(k[full], np.full(int(full.sum()), RECUR), h[full].view(np.int64), place[full] - REACH, place[full])
        # A group of two or more different contexts is compared, one of each; equal ones are settled already.
        different = np.bincount(group, other)
        open_group = np.bincount(group, ~full) > 0
        crowd = h[new][(different > most) & open_group].view(np.int64)
        none = np.zeros(len(crowd), np.int64)
        yield _found(none, none + CROWDED, crowd, none, none)
        ask = ((different > 1) & (different <= most) & open_group)[group] & other
        yield _found(k[ask], np.full(int(ask.sum()), ASK), h[ask].view(np.int64), place[ask], full[ask].astype(np.int64))

    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_arrow(packed.repartition(n, "slot").sortWithinPartitions("slot"), run, _FOUND)


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The packed values of all rows, one after another; the table they come from need not be kept."""
    column = column.cast(pa.large_binary()).combine_chunks()
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, kind)
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].copy().view(kind)


def _found(k, kind, h, place, till) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x), f.type, safe=False) for x, f in zip((k, kind.astype(np.int32), h, place.astype(np.int32), till.astype(np.int32)), _FOUND_SCHEMA, strict=True)], schema=_FOUND_SCHEMA)


def contexts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(part, side, k, place, lo, hi, settled, before, bytes): what is around each anchor asked for, once for either side.

    A string that begins HALF bytes or more before the anchor holds the HALF bytes to its left (side 0), one that begins
    at most so many before it holds the LENGTH - HALF bytes from it on (side 1). So equal strings meet if anchors meet
    by either of these. part: a hash of those bytes; lo, hi: how many bytes before the anchor the strings begin.
    """
    listed = asked.groupBy("k").agg(F.collect_set(F.struct("place", "till")).alias("asked"))
    joined = docs.select("k", F.encode("text", "UTF-8").alias("raw")).join(listed, "k").select("k", "raw", F.explode("asked").alias("x"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    before = F.least(F.col("x.place"), F.when(F.col("side") == 0, REACH).otherwise(HALF))
    after = F.when(F.col("side") == 0, LENGTH - HALF).otherwise(LENGTH)
    cut = joined.select("side", "k", "x.place", F.col("x.till").alias("settled"), before.alias("before"), F.substring("raw", F.col("x.place") - before + 1, before + after).alias("bytes"))
    key = F.when(F.col("side") == 0, F.substring("bytes", F.col("before") - HALF + 1, F.lit(HALF + GRAM))).otherwise(F.substring("bytes", F.col("before") + 1, F.lit(LENGTH - HALF)))
    whole = F.when(F.col("side") == 0, F.col("before") >= HALF).otherwise(F.octet_length("bytes") - F.col("before") >= LENGTH - HALF)
    low, high = F.when(F.col("side") == 0, HALF).otherwise(0), F.when(F.col("side") == 0, REACH).otherwise(HALF)
    return cut.where(whole).select(F.xxhash64("side", key).alias("part"), "side", "k", "place", low.alias("lo"), high.alias("hi"), "settled", "before", "bytes").dropDuplicates(["side", "k", "place"])


def _halved(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Each (k, place, lo, hi, settled, before, bytes) for either half of lo..hi, with a hash of the bytes that all strings
    of that half hold (part). Of those in one block that agree in all bytes of their strings, one goes on; they recur, and
    are given once more, or alone, without bytes."""
    nodes: list[list] = []
    done: list[list] = []
    first: dict[tuple[int, bytes], list] = {}

    def block() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*nodes, *done, strict=True), _NODES_SCHEMA, strict=True)], schema=_NODES_SCHEMA)
        for x in (nodes, done, first):
            x.clear()
        return out

    for k, place, lo, hi, settled, before, raw in rows:
        middle, after = (lo + hi) // 2, len(raw) - before
        for low, high in ((lo, middle), (middle + 1, hi)):
            if before < low or after < LENGTH - high or low > high:
                continue
            part = xxhash.xxh3_64_intdigest(raw[before - low : before + LENGTH - high], seed=low << 8 | high) - (1 << 63)
            left = min(before, high)
            node = [part, k, place, low, high, settled, left, raw[before - left : before + LENGTH - low]]
            if before >= high and after >= LENGTH - low and (other := first.setdefault((part, node[-1]), node)) is not node:
                done += [[*x[:-1], None] for x in (other, node) if not x[5]]
                other[5] = 1
            else:
                nodes.append(node)
        if len(nodes) + len(done) >= 2 * CONTEXTS:
            yield block()
    if nodes or done:
        yield block()


def crowded(docs: DataFrame, hashes: np.ndarray) -> DataFrame:
    """What is around the anchors of these hashes (ascending), as _halved tells it."""
    shared = docs.sparkSession.sparkContext.broadcast(hashes)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        wanted = shared.value
        low = np.zeros(1 << 16, bool)
        low[wanted & np.uint64(0xFFFF)] = True
        for batch in batches:
            for keys, base, t in _pieces(batch):
                if len(t.data) < LENGTH:
                    continue
                h = _window_hashes(t, GRAM)
                seen = np.flatnonzero(low[h & np.uint64(0xFFFF)])
                which = np.unique(np.searchsorted(t.bounds, seen[np.isin(h[seen], wanted)], side="right") - 1)
                raws = [t.data[t.bounds[i] : t.bounds[i + 1]].tobytes() for i in which.tolist()]
                found = block_anchors(Texts(np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)])))
                if found is None:
                    continue
                held = np.isin(found[0], wanted)
                for i, at in zip(found[2][held].tolist(), found[3][held].tolist(), strict=True):
                    before = min(at, REACH)
                    yield int(keys[which[i]]), at + int(base[which[i]]), 0, REACH, 0, before, raws[i][at - before : at + LENGTH]

    return in_arrow(docs.select("k", "text"), lambda batches: _halved(around(batches)), _NODES)


def taken_apart(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What recurs (k, place, till), and contexts as from contexts(), at most CROWD of a part; only where all strings of a
    part are the same may there be more, one for each block that holds them. Parts with more are halved, in place."""

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _halved(x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True))

    recur, few = [], []
    while True:
        nodes = written(nodes)
        recur.append(nodes.where("bytes IS NULL").select("k", (F.col("place") - F.col("hi")).alias("place"), (F.col("place") - F.col("lo")).alias("till")))
        nodes = nodes.where("bytes IS NOT NULL")
        # At most one in CROWD of the contexts.
        large = checkpointed(nodes.where("lo < hi").groupBy("part").count().where(F.col("count") > CROWD).select("part"))
        if large.isEmpty():
            few.append(nodes)
            break
        few.append(nodes.join(F.broadcast(large), "part", "left_anti"))
        nodes = in_arrow(nodes.join(F.broadcast(large), "part", "left_semi").select("k", "place", "lo", "hi", "settled", "before", "bytes"), halves, _NODES)
    side = F.when(F.col("lo") > HALF, 0).otherwise(1)
    context = reduce(DataFrame.unionByName, few).select("part", side.alias("side"), "k", "place", "lo", "hi", "settled", "before", "bytes")
    return reduce(DataFrame.unionByName, recur), context


def suffix_order(p: np.ndarray, down: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes data[start:start + length] within their groups (contiguous), and the common extension of
    each with the one before it (0 at a group's first). Mergesort: runs of doubling width are merged by each element's
    binary search in the other run; two suffixes are compared by their common extension and the byte after it."""
    m = len(start)
    order = np.arange(m)
    begin = np.searchsorted(group, group)
    size = np.bincount(group, minlength=int(group[-1]) + 1)[group] if m else np.zeros(0, np.int64)

    def less(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        most = np.minimum(length[x], length[y])
        n = _common(p, down, start[x], start[y], most)
        end = n >= most
        bx = np.where(n < length[x], data[np.minimum(start[x] + n, len(data) - 1)].astype(np.int64), -1)
        by = np.where(n < length[y], data[np.minimum(start[y] + n, len(data) - 1)].astype(np.int64), -1)
        return np.where(end & (length[x] == length[y]), ties, bx < by)

    width = 1
    while m and width < size.max():
        at = np.flatnonzero(size > width)
        rank = at - begin[at]
        run = rank // width
        mate = begin[at] + (run ^ 1) * width
        low = np.minimum(mate, begin[at] + size[at])
        high = np.minimum(mate + width, begin[at] + size[at])
        floor, is_right = low.copy(), run % 2 == 1
        open_at = np.flatnonzero(low < high)
        while len(open_at):
            middle = (low[open_at] + high[open_at]) // 2
            # An equal suffix of the left run comes first.
            before = less(order[middle], order[at[open_at]], is_right[open_at])
            low[open_at] = np.where(before, middle + 1, low[open_at])
            high[open_at] = np.where(before, high[open_at], middle)
            open_at = open_at[low[open_at] < high[open_at]]
        to = begin[at] + (run & ~1) * width + rank % width + (low - floor)
        moved = order.copy()
        moved[to] = order[at]
        order = moved
        width *= 2
    common = np.zeros(m, np.int64)
    if m > 1:
        x, y = order[:-1], order[1:]
        same = group[1:] == group[:-1]
        n = _common(p, down, start[x], start[y], np.minimum(length[x], length[y]))
        common[1:] = np.where(same, _checked(data, start[x], start[y], n), 0)
    return order, common


def _checked(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The extensions n found by hashes, shortened to what the bytes bear out."""
    out = n.copy()
    for at in range(0, len(a), 2048):
        cut = slice(at, at + 2048)
        steps = np.arange(int(n[cut].max(initial=0)))
        i, j = a[cut, None] + steps, b[cut, None] + steps
        wrong = (data[np.minimum(i, len(data) - 1)] != data[np.minimum(j, len(data) - 1)]) & (steps < n[cut, None])
        bad = wrong.any(1)
        if bad.any():
            out[cut] = np.where(bad, wrong.argmax(1), out[cut])
    return out


def left_order(before: np.ndarray, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the contexts by what is left of their anchors, read backwards, and how many bytes each has in common
    there with the one before it."""
    lefts = [x[:n][::-1] for x, n in zip(parts, before.tolist(), strict=True)]
    order = np.array(sorted(range(len(parts)), key=lefts.__getitem__), np.int64)
    seen = np.array([lefts[i].ljust(REACH, b"\0") for i in order], f"S{REACH}").view(np.uint8).reshape(-1, REACH)
    common = np.zeros(len(parts), np.int64)
    unequal = seen[1:] != seen[:-1]
    n = np.where(unequal.any(1), unequal.argmax(1), REACH)
    common[1:] = np.minimum(n, np.minimum(before[order[1:]], before[order[:-1]]))
    return order, common


def recurring(group: np.ndarray, before: np.ndarray, parts: list[bytes], low: int | np.ndarray = 0, high: int | np.ndarray = REACH) -> np.ndarray:
    """[i, d]: whether the string that begins d bytes before anchor i, low <= d <= high (of each i), recurs in another of the
    same group (ascending). Nothing rests on a hash alone: extensions to the right are checked by the bytes, those to the
    left are taken from them."""
    t = Texts(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]))
    p = t.prefix()
    _, down = _powers(len(t.data) + 1)
    group = np.cumsum(np.concatenate([[True], group[1:] != group[:-1]])) - 1
    anchor = t.bounds[:-1] + before
    length = t.bounds[1:] - anchor
    order, common = suffix_order(p, down, t.data, anchor, length, group)
    first = np.concatenate([[True], group[order][1:] != group[order][:-1]])
    left, left_common = left_order(before, parts)
    out = np.zeros((len(parts), REACH + 1), bool)
    right_class, left_class = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    for d in range(int(np.min(low)), int(np.max(high)) + 1):
        fits = np.flatnonzero((before >= d) & (length >= LENGTH - d) & (low <= d) & (high >= d))
        if len(fits) < 2:
            continue
        right_class[order] = np.cumsum(first | (common < LENGTH - d))
        left_class[left] = np.cumsum(left_common < d)
        key = right_class[fits] * (len(parts) + 1) + left_class[fits]
        by = np.argsort(key)
        same = key[by][1:] == key[by][:-1]
        out[fits[by[1:][same]], d] = True
        out[fits[by[:-1][same]], d] = True
    return out


def compared(context: DataFrame) -> DataFrame:
    """(k, kind, h, place, till) of the strings that recur among contexts of equal anchors; h is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in regathered(batches, 2, CONTEXTS * (REACH + LENGTH)):
            side = table["side"].to_numpy()
            for which in (0, 1):
                yield from settle(table.filter(pa.array(side == which)))

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        part = table["part"].to_numpy()
        if not len(part):
            return
        new = np.concatenate([[True], part[1:] != part[:-1]])
        several = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
        if not several.any():
            return
        table, part = table.filter(pa.array(several)), part[several]
        before, place = table["before"].to_numpy().astype(np.int64), table["place"].to_numpy().astype(np.int64)
        found = recurring(part, before, table["bytes"].to_pylist(), table["lo"].to_numpy(), table["hi"].to_numpy())
        found[table["settled"].to_numpy() > 0] = False  # known already
        padded = np.pad(found, ((0, 0), (1, 1))).astype(np.int8)
        row, edge = np.nonzero(np.diff(padded, axis=1))
        who, d1, d2 = row[::2], edge[::2], edge[1::2] - 1
        if len(who):
            yield _found(table["k"].to_numpy()[who], np.full(len(who), RECUR), np.zeros(len(who), np.int64), place[who] - d2, place[who] - d1)

    n = int(context.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_arrow(context.repartition(n, "part", "side").sortWithinPartitions("part", "side").select("part", "side", "k", "place", "lo", "hi", "settled", "before", "bytes"), run, _FOUND)


def removed_spans(docs: DataFrame) -> DataFrame:
    """(k, starts): the (from, to) of starts at which recurring strings begin; docs has k and text. Rows of the same k are
    copies: all of each recurs, and one goes on to be compared with others."""
    found = checkpointed(repeated(anchors(docs)))
    settled = found.where(F.col("kind") == RECUR).select("k", "place", "till")
    around = contexts(docs, found.where(F.col("kind") == ASK))
    # Eight bytes for more than CROWD contexts of several hundred bytes each.
    crowds = [x.h for x in found.where(F.col("kind") == CROWDED).select("h").collect()]
    if crowds:
        recur, context = taken_apart(crowded(docs, np.unique(np.array(crowds, np.int64).view(np.uint64))))
        settled, around = settled.unionByName(recur), around.unionByName(context)
    more = compared(around)
    # Rows are copies if a hash of another kind, the size and the document agree too.
    size, proof = F.octet_length("text"), F.xxhash64("text", F.lit(1))
    copies = docs.groupBy("k").agg(F.count("*").alias("n"), F.max(size).alias("size"), F.min(size).alias("least"), F.max(proof).alias("p"), F.min(proof).alias("q"))
    copies = copies.where((F.col("n") > 1) & (F.col("size") >= LENGTH) & (F.col("size") == F.col("least")) & (F.col("p") == F.col("q"))).select("k", F.lit(0).alias("place"), (F.col("size") - LENGTH).alias("till"))
    starts = settled.unionByName(more.select("k", "place", "till")).unionByName(copies)
    return starts.groupBy("k").agg(F.collect_set(F.struct("place", "till")).alias("starts"))


def cut_document(raw: bytes, starts: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The bytes left, how many were removed, and in how many maximal runs."""
    kept, removed, spans, at = [], 0, 0, 0
    end = -1
    for first, last in sorted(starts):
        if first > end:
            if spans:
                removed += end - begin
                at = end
            kept.append(raw[at:first])
            begin, spans = first, spans + 1
            end = last + LENGTH
        else:
            end = max(end, last + LENGTH)
    if spans:
        removed += end - begin
        at = end
    kept.append(raw[at:])
    return b"".join(kept), removed, spans


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row: the UTF-8 bytes that are left, after removal of each
    byte that a LENGTH-byte string covers which also starts at another place, in the same row or another.

    Strings are judged on the input and never cross rows; null counts as empty; repeated rows are copies of each other
    and lose what they share, all of it from LENGTH bytes on. Other columns are ignored. Texts of 2 GB or more
    are not supported.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.xxhash64("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                raws = [x.encode() for x in part.column(1).to_pylist()]
                cut = [cut_document(raw, [(x["place"], x["till"]) for x in starts or ()]) for raw, starts in zip(raws, part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raws), pa.int64()), pa.array([x[1] for x in cut], pa.int64()), pa.array([x[2] for x in cut], pa.int64()), pa.array([x[0] for x in cut], pa.binary())], schema=schema)

    joined = rows.join(removed_spans(rows), "k", "left")
    return in_arrow(joined.select("doc_id", "text", "starts"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(cut: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hexed = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column(4)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], hexed], schema=schema)

    return in_arrow(cut, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
