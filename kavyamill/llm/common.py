"""What the operators share: sessions, bounded label samples, text arrays in numpy."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy kernels work on at once; a longer text makes a block of its own.
BLOCK = 1 << 18
#: The whitespace that ends a word, [\x20\x09-\x0D].
SPACE_BYTES = (9, 10, 11, 12, 13, 32)

SPACE = np.zeros(256, bool)
SPACE[list(SPACE_BYTES)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(session: SparkSession) -> str:
    """The checkpoint folder that all executors share; where spark.checkpoint.dir is unset, one in the warehouse, which is shared too."""
    context = session.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(session.conf.get("spark.checkpoint.dir", None) or f"{session.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.checkpoints")
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, its lineage cut."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As checkpointed(), as a Parquet table: for many narrow rows, which take several times their size as raw rows."""
    path = f"{_shared_folder(df.sparkSession).rstrip('/')}/{uuid.uuid4()}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores after it as no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """df.mapInArrow(run, ddl) whose Python workers, which Spark keeps for later tasks, give back the memory they don't use."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc alone has it
                trim(0)

    return df.mapInArrow(released, ddl)


def labelled_sample(labels: DataFrame, column: str, bound: int) -> DataFrame:
    """At most `bound` labelled rows (doc_id, label), the same for any partitioning; safe to broadcast."""
    rows = labels.select(F.col("doc_id").cast("long"), F.col(column).cast("int").alias("label")).dropna()
    return rows.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def one_a_document(rows: DataFrame) -> DataFrame:
    """The least row of each doc_id: of a labelled sample, no more rows than labels."""
    return rows.groupBy("doc_id").agg(F.min(F.struct(*(x for x in rows.columns if x != "doc_id"))).alias("least")).select("doc_id", "least.*")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, BLOCK + 4096)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


class Texts:
    """Some texts as one byte array: text i is data[bounds[i]:bounds[i + 1]]."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds, self.n = data, bounds, len(bounds) - 1
        self._prefix: np.ndarray | None = None

    @classmethod
    def of(cls, strings: Iterable[str]) -> Texts:
        raw = [s.encode() for s in strings]
        return cls(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]).astype(np.int64))

    def prefix(self) -> np.ndarray:
        """Prefix polynomial hashes, modulo 2^64."""
        if self._prefix is None:
            up, _ = _powers(len(self.data) + 1)
            self._prefix = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=self._prefix[1:])
        return self._prefix

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each data[start:end], the same wherever the bytes stand."""
        p = self.prefix()
        _, down = _powers(len(self.data) + 1)
        return mix((p[end] - p[start]) * down[start] + (end - start).astype(np.uint64))

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text the mask holds."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each maximal run of bytes inside, never across texts."""
        n = len(inside)
        if not n:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty
        edge = np.zeros(n + 1, bool)
        edge[self.bounds] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:n]
        last[:-1] &= ~inside[1:] | edge[1:n]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return start, end, np.searchsorted(self.bounds, start, side="right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.runs(~SPACE[self.data])


def text_blocks(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK) -> Iterator[tuple[int, int, Texts]]:
    """Row ranges of a batch, of at most `most` bytes or one text, with their texts; null counts as empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1)
        yield at, to, Texts(raw[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
        at = to


def cuts(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of places, in order, that end where their sizes reach `most`."""
    at, held = 0, 0
    for i, size in enumerate(sizes, 1):
        held += size
        if held >= most or i == len(sizes):
            yield at, i
            at, held = i, 0


def shingle_hashes(word_hash: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, and the index of each one's first word."""
    if len(word_hash) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(word_hash) - k + 1
    h = np.zeros(m, np.uint64)
    for j in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + word_hash[j : j + m]
    at = np.flatnonzero(text[:m] == text[k - 1 :])
    return mix(h[at]), at


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def regathered(batches: Iterator[pa.RecordBatch], keys: int, most: int) -> Iterator[pa.Table]:
    """Batches sorted by their first `keys` columns, cut anew: each table holds whole keys, and ends at the first border
    between two of them beyond `most` bytes. Only a key that is larger by itself makes a larger table."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        new[0] = last is not None and last != tuple(c[0] for c in columns)
        last = tuple(c[-1] for c in columns)
        row = max(1, batch.nbytes // batch.num_rows)
        borders, at = np.flatnonzero(new), 0
        while True:
            i = int(np.searchsorted(borders, max(at + (0 if held else 1), at + (most - size) // row)))
            if i == len(borders):
                break
            held.append(batch.slice(at, borders[i] - at))
            yield pa.Table.from_batches(held)
            held, size, at = [], 0, int(borders[i])
        held.append(batch.slice(at))
        size += row * (batch.num_rows - at)
    if held:
        yield pa.Table.from_batches(held)
