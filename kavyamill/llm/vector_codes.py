"""Vector codes: integer vectors cut into parts, each part replaced by the index of its codebook's nearest entry.

Nearest entries are exact. A float32 matrix product screens: from the rounding errors that it can have made follows an
interval around each squared distance, and every entry whose interval reaches the best one's is evaluated again in
int64; equal distances go to the lower index. Codebooks are refined by rounds of integer means. A codebook's size is
fixed, so it is sent to every task; of the table only one row a task, part and entry is shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kavyamill.llm.common import checkpointed, in_arrow

#: Integer steps in one unit of a component.
SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Vectors that are screened at once, and pairs of vector and entry that are evaluated at once.
TOGETHER, PAIRS = 2048, 1 << 16


def kept_rows(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the batch of the vectors that have `width` components, none of them null or not finite, and these as
    integers, floor(SCALE * x). Integers so large that a squared distance may not fit in 64 bits are an error."""
    vectors = batch.column("embedding")
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    offsets = vectors.offsets.to_numpy().astype(np.int64)
    values = vectors.values
    x = values.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    size = np.diff(offsets)
    valid = vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]])
    at = np.flatnonzero(valid & (size == width))
    whole = np.floor(x[offsets[at][:, None] + np.arange(width)] * SCALE)
    largest = math.isqrt((1 << 63) // width) // 2 - 1
    if np.abs(whole).max(initial=0) > largest:
        raise ValueError(f"vectors of {width} components are compressed while no integer floor({SCALE} * x) is beyond {largest}")
    return at, whole.astype(np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the index of the nearest row of entries, the lower of equally near ones, and the squared
    distance. An entry that equals one before it can't win and isn't screened."""
    _, first = np.unique(entries, axis=0, return_index=True)
    first.sort()
    best, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    if not len(x):
        return best, distance
    e = entries[first]
    short = e.astype(np.float32)
    norm = (e.astype(np.float64) ** 2).sum(1)
    longest = np.sqrt(norm.max())
    # Each of the sum's products is rounded, each addition too, and integers over 2^24 when they become float32; then
    # the norm, and the difference. With u = 2^-24 the relative errors of (width + 8) roundings, a little enlarged.
    slack = (x.shape[1] + 8) * 2.0**-24 * 1.01
    for at in range(0, len(x), TOGETHER):
        part = x[at : at + TOGETHER]
        score = norm.astype(np.float32) - np.float32(2) * (part.astype(np.float32) @ short.T)  # the distance without |x|^2
        error = slack * (norm.max() + 2 * np.sqrt((part.astype(np.float64) ** 2).sum(1)) * longest)
        reach = np.nextafter((score.min(1).astype(np.float64) + 2 * error).astype(np.float32), np.float32(np.inf))
        row, column = np.nonzero(score <= reach[:, None])  # by row, then by index
        exact = np.concatenate([((part[row[i : i + PAIRS]] - e[column[i : i + PAIRS]]) ** 2).sum(1) for i in range(0, len(row), PAIRS)])
        begins = np.searchsorted(row, np.arange(len(part)))
        least = np.minimum.reduceat(exact, begins)
        hits = np.flatnonzero(exact == least[row])
        winner = hits[np.searchsorted(row[hits], np.arange(len(part)))]
        best[at : at + TOGETHER], distance[at : at + TOGETHER] = first[column[winner]], least
    return best, distance


def width_of(vectors: DataFrame) -> int | None:
    """The most frequent length of a vector that PARTS divides (the shorter of equally frequent ones); None if no row has one."""
    size = F.size("embedding")
    sizes = vectors.where(F.col("embedding").isNotNull()).select(size.alias("size")).where((F.col("size") > 0) & (F.col("size") % PARTS == 0))
    row = sizes.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    return row["size"] if row else None


def starting(vectors: DataFrame, width: int, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks, part by entry by place: the parts of the `entries` kept vectors with the least vec_ids (of one id, the
    least vectors first; rows without an id are not taken), ascending. Only these come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = kept_rows(batch, width)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), pa.array(list(x), pa.list_(pa.int64()))], names=["vec_id", "x"])

    rows = in_arrow(vectors.where("vec_id is not null"), run, "vec_id long, x array<long>").orderBy("vec_id", "x").limit(entries).toArrow()
    x = np.array(rows["x"].to_pylist(), np.int64).reshape(rows.num_rows, width)
    return np.stack(np.split(x, PARTS, axis=1))


def refined(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floor of the mean of the parts that it is nearest to; unused ones stay.

    A task sums before anything is shuffled, in decimals after, so that no number of rows can overflow."""
    parts, entries, place = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, place), np.int64)
        for batch in batches:
            _, x = kept_rows(batch, parts * place)
            for k, part in enumerate(np.split(x, parts, axis=1)):
                best, _ = nearest(part, books[k])
                n += np.bincount(best + k * entries, minlength=len(n))
                np.add.at(total, best + k * entries, part)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], names=["slot", "n", "total"])

    sums = in_arrow(vectors, run, "slot int, n long, total array<long>").groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")).alias(f"t{i}") for i in range(place)])
    out = books.reshape(parts * entries, place).copy()
    for row in sums.collect():
        out[row["slot"]] = [int(t) // row["n"] for t in row[2:]]
    return out.reshape(books.shape)


def fit(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (part, entry, place) of (vec_id, embedding) after `rounds` rounds over all rows; None if no row counts."""
    width = width_of(vectors)
    books = starting(vectors, width, entries) if width else np.zeros((PARTS, 0, 0), np.int64)
    if not books.shape[1]:
        return None
    for _ in range(rounds):
        books = refined(vectors, books)
    return books


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (an index for each part, two hex digits) and error (squared distances, summed) of each kept row.

    Rows whose vector is null or holds null or non-finite components are left out, as are those of another length than
    the codebooks'. Repeated rows repeat; a null vec_id or label stays null.
    """
    parts, _, place = books.shape
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("code", pa.string()), ("error", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = kept_rows(batch, parts * place)
            found = [nearest(part, books[k]) for k, part in enumerate(np.split(x, parts, axis=1))]
            codes = np.stack([best for best, _ in found], axis=1).astype(np.uint8)
            error = sum((d for _, d in found), np.zeros(len(x), np.int64))
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(rows), batch.column("label").take(rows), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], schema=schema)

    return in_arrow(vectors, run, "vec_id long, label long, code string, error long")


def digest(books: np.ndarray) -> str:
    """Of all entries' components by part, entry and place, in decimals between commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(table: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, most_labels: int = 50_000) -> DataFrame:
    """vec_id, code, error, label_error (errors of all rows with the label, nulls together) and codebooks_sha256 of each
    kept row of (vec_id, embedding, label). An empty table, or one without a usable vector, has no rows.

    Labels' sums are broadcast where there are at most `most_labels` of them, and joined by label otherwise: a join
    whose hot labels Spark splits. Other columns are ignored.
    """
    exact = table.schema["embedding"].dataType.simpleString() in ("array<float>", "array<double>")
    vector = F.col("embedding") if exact else F.col("embedding").cast("array<double>")
    vectors = table.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"), F.col("label").cast("long").alias("label"))
    books = fit(vectors.select("vec_id", "embedding"), entries, rounds)
    if books is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = checkpointed(encode(vectors, books))
    # The null label gets a key of its own, so that the join needs no null-safe comparison.
    key = F.struct(F.coalesce("label", F.lit(0)).alias("label"), F.col("label").isNull().alias("none"))
    totals = coded.groupBy(key.alias("key")).agg(F.sum("error").alias("label_error"))
    few = totals.limit(most_labels + 1).count() <= most_labels
    joined = coded.withColumn("key", key).join(F.broadcast(totals) if few else totals, "key", "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
