"""Quality classifier by importance resampling: target and raw texts as bags of hashed n-grams.

A document's log-weight is the mean log ratio of its n-grams' probabilities under the target model (documents
labelled good) and the raw model (all documents), times a fixed number of n-grams, so that length neither helps nor
hurts. With Gumbel noise added, the largest k keys are a sample without replacement in proportion to the weights.
k is the number of documents whose log-weight reaches a cutoff, set on the labelled sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kavyamill.llm.common import Texts, checkpointed, in_arrow, labelled_sample, mix, one_a_document, text_blocks, unused

BUCKETS = 1 << 15
#: The mean log ratio counts for so many n-grams.
NGRAMS = 256.0
SMOOTHING = 1.0

_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER = np.isin(np.arange(256), range(65, 91))


def ngrams(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of each n-gram: lower-cased words, marks and digits, their shapes, and pairs of either.

    A shape is the kind (letters, digits, marks), the case, the length up to 15, and whether the token before the
    last mark repeats.
    """
    kind = _KIND[t.data]
    edge = np.zeros(len(kind) + 1, bool)
    edge[t.bounds] = True
    first = (kind > 0) & (np.concatenate([[0], kind[:-1]]).astype(np.uint8)[: len(kind)] != kind)
    first |= (kind > 0) & edge[: len(kind)]
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.flatnonzero(np.concatenate([kind[1:] != kind[:-1], [True]]) | edge[1:])
    end = breaks[np.searchsorted(breaks, start)] + 1
    text = np.searchsorted(t.bounds, start, side="right") - 1
    upper = np.concatenate([[0], np.cumsum(_UPPER[t.data])])
    n_upper, length = upper[end] - upper[start], end - start
    token = Texts(_LOWER[t.data], t.bounds).hashes(start, end)
    same = np.zeros(len(token), np.uint64)
    for back in (1, 2):
        same[back:] |= ((token[back:] == token[:-back]) & (text[back:] == text[:-back])).astype(np.uint64)
    case = (n_upper > 0).astype(np.uint64) + ((n_upper > 1) & (2 * n_upper >= length)).astype(np.uint64)
    shape = mix(((kind[start].astype(np.uint64) * np.uint64(4) + case) * np.uint64(16) + np.minimum(length, 15).astype(np.uint64)) * np.uint64(2) + same + np.uint64(1 << 40))
    parts, texts = [token, shape], [text, text]
    follows = np.flatnonzero(text[1:] == text[:-1])
    for one in (token, shape):
        parts.append(mix(one[follows] * np.uint64(0xD6E8FEB86659FD93) + one[follows + 1]))
        texts.append(text[follows])
    return np.concatenate(texts), (np.concatenate(parts) % np.uint64(BUCKETS)).astype(np.int64)


def counts(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """Log ratio of each bucket: raw counts over all documents, target counts over the sample's good ones."""
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left").select("text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            good = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False) == 1
            for at, to, t in text_blocks(batch):
                text, bucket = ngrams(t)
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[good[at:to][text]], minlength=BUCKETS)
        found = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(raw[found]), pa.array(target[found])], names=["bucket", "raw", "target"])

    total = in_arrow(rows, run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[total["bucket"].to_numpy()], target[total["bucket"].to_numpy()] = total["raw"].to_numpy(), total["target"].to_numpy()
    if not target.sum():
        return np.zeros(BUCKETS)
    # The raw share smooths the target's: a bucket that the target has not seen is not taken to be impossible.
    prior = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    return np.log((target + SMOOTHING * BUCKETS * prior) / (target.sum() + SMOOTHING * BUCKETS)) - np.log(prior)


def with_log_weight(rows: DataFrame, ratio: np.ndarray, name: str = "log_weight") -> DataFrame:
    """rows with the log-weight of their text in one more column; null for a text without n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, t in text_blocks(batch):
                text, bucket = ngrams(t)
                n = np.bincount(text, minlength=t.n)
                weight = NGRAMS * np.bincount(text, ratio[bucket], t.n) / np.maximum(n, 1)
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(weight, mask=n == 0)], names=[*part.schema.names, name])

    return in_arrow(rows, run, StructType([*rows.schema.fields, StructField(name, DoubleType())]))


def key_of(log_weight: str) -> Column:
    """The log-weight plus Gumbel noise that the doc_id draws."""
    uniform = (F.abs(F.xxhash64(F.lit("gumbel"), F.col("doc_id").cast("long")) % (1 << 52)) + 0.5) / float(1 << 52)
    return F.col(log_weight) - F.log(-F.log(uniform))


def cutoff_of(weight: np.ndarray, good: np.ndarray, kept_share: float) -> float:
    """The largest cutoff that keeps `kept_share` of the good rows, or the middle between them and the worse rows' if that is lower."""
    low = float(np.quantile(weight[good], 1 - kept_share))
    worse = weight[~good & (weight < low)]
    return (low + float(np.quantile(worse, 0.9))) / 2 if len(worse) else low


def kth_largest(df: DataFrame, key: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value of a double column, exactly, by counts in ever finer bins: `bins` rows to the driver each time."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    above = 0
    while low < high:
        width = (high - low) / bins
        if low + width == low or low + width >= high:
            break
        at = F.least(F.lit(bins - 1), F.floor((F.col(key) - F.lit(low)) / F.lit(width)).cast("int"))
        found = df.where(F.col(key).between(low, high)).groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy(F.desc("b")).collect()
        for row in found:
            if above + row.n >= k:
                low, high = row.lo, row.hi
                break
            above += row.n
        else:
            break
    return high if low == high else df.where(F.col(key).between(low, high)).select(key).orderBy(F.desc(key)).limit(max(1, k - above)).agg(F.min(key)).first()[0]


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000, kept_share: float = 0.995) -> tuple[np.ndarray, DataFrame, float]:
    """The buckets' log ratios, (doc_id, log_weight, key) of every row of docs, and the k-th largest key.

    The target model and the cutoff come from at most `most_labelled` labelled rows; raw counts, k and the k-th key
    from all documents. Without a good label every key is large enough.
    """
    sample = labelled_sample(labels, "quality", most_labelled)
    ratio = counts(docs, sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "label")
    scored = checkpointed(with_log_weight(rows, ratio).select("doc_id", "log_weight", key_of("log_weight").alias("key"), "label"))
    judged = one_a_document(scored.where("label is not null and log_weight is not null").select("doc_id", "log_weight", "label")).toArrow()
    weight, good = judged["log_weight"].to_numpy(), judged["label"].to_numpy() == 1
    if not good.any():
        return ratio, scored, -np.inf
    k = scored.where(F.col("log_weight") >= F.lit(cutoff_of(weight, good, kept_share))).count()
    return ratio, scored, kth_largest(scored.where("key is not null"), "key", k) if k else np.inf


def classify(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000, kept_share: float = 0.995) -> DataFrame:
    """doc_id, log_weight, key (log_weight plus Gumbel noise) and kept of every row of docs.

    The k rows of the largest keys are kept (see fit()). Without a good label all texts with an n-gram are kept. Null,
    empty and blank texts, which have no n-gram, are not kept. Equal keys at the border are all kept, so repeated rows
    share one fate. Other columns of docs are ignored.
    """
    _, scored, least = fit(docs, labels, most_labelled, kept_share)
    return scored.select("doc_id", "log_weight", "key", F.coalesce(F.col("key") >= F.lit(float(least)), F.lit(False)).alias("kept"))


def select_good(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000, kept_share: float = 0.995) -> DataFrame:
    """The rows of docs, with all their columns, that classify() keeps; weighed anew rather than joined."""
    ratio, _, least = fit(docs, labels, most_labelled, kept_share)
    weight = unused(docs, "_log_weight")
    return with_log_weight(docs, ratio, weight).where(key_of(weight) >= F.lit(float(least))).drop(weight)
