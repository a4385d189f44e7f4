"""Toxicity: cumulative-link ordinal regression over sparse word features.

P(grade <= g) = sigmoid(threshold_g - w.x): one weight for each hashed word, shared by all thresholds. Labels tell
only toxic from not, so the grades of toxic rows follow how many distinct marker words (words that are far more
frequent in toxic rows of the sample) they hold: one or none, two or three, four or more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kavyamill.llm.common import Texts, in_arrow, labelled_sample, mix, one_a_document, record_batch, text_blocks

GRADES = 4
#: Marker words of a toxic row from which its grade is 2, and 3.
GRADE_MARKERS = (2, 4)
BUCKETS = 1 << 22

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])


def word_features(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs of lower-cased words: runs of ASCII letters and non-ASCII bytes."""
    lower = Texts(_LOWER[t.data], t.bounds)
    start, end, text = lower.runs(_LETTER[lower.data])
    key = np.unique(text.astype(np.uint64) * np.uint64(BUCKETS) + lower.hashes(start, end) % np.uint64(BUCKETS))
    return (key // np.uint64(BUCKETS)).astype(np.int64), (key % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class OrdinalModel:
    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def linear(self, t: Texts) -> np.ndarray:
        text, bucket = word_features(t)
        if not len(self.buckets) or not len(text):
            return np.zeros(t.n)
        at = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
        return np.bincount(text, np.where(self.buckets[at] == bucket, self.weights[at], 0.0), t.n)

    def grades(self, linear: np.ndarray) -> np.ndarray:
        """Probability of each grade, a row for each value."""
        below = _sigmoid(self.thresholds[None, :] - linear[:, None])
        return np.diff(below, axis=1, prepend=0.0, append=1.0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _selected(bucket: np.ndarray, toxic: np.ndarray, n: int, n_toxic: int, least: int, z: float) -> tuple[np.ndarray, np.ndarray]:
    """Buckets whose share among toxic rows differs by z standard errors, and how much more frequent each is there."""
    names, inverse = np.unique(bucket, return_inverse=True)
    rows = np.bincount(inverse, minlength=len(names)).astype(float)
    hits = np.bincount(inverse, toxic, len(names))
    p1, p0, p = hits / max(n_toxic, 1), (rows - hits) / max(n - n_toxic, 1), rows / max(n, 1)
    error = np.sqrt(p * (1 - p) * (1 / max(n_toxic, 1) + 1 / max(n - n_toxic, 1))) + 1e-12
    good = (rows >= least) & (np.abs(p1 - p0) >= z * error)
    ratio = (hits + 0.5) / (n_toxic + 1) / ((rows - hits + 0.5) / (n - n_toxic + 1))
    return names[good], ratio[good]


def fit(row: np.ndarray, bucket: np.ndarray, toxic: np.ndarray, least: int = 4, z: float = 4.0, marker_ratio: float = 8.0, sparsity: float = 3e-5, steps: int = 500) -> OrdinalModel:
    """Proximal gradient descent on the mean negative log-likelihood with an L1 penalty."""
    n = len(toxic)
    buckets, ratio = _selected(bucket, toxic[row], n, int(toxic.sum()), least, z)
    if not len(buckets):
        return OrdinalModel(buckets, np.zeros(0), np.arange(GRADES - 1) + np.log((n - toxic.sum() + 1) / (toxic.sum() + 1)))
    at = np.minimum(np.searchsorted(buckets, bucket), len(buckets) - 1)
    kept = buckets[at] == bucket
    row, col = row[kept], at[kept]
    markers = np.bincount(row, ratio[col] >= marker_ratio, n)
    grade = np.where(toxic > 0, 1 + (markers >= GRADE_MARKERS[0]) + (markers >= GRADE_MARKERS[1]), 0).astype(int)
    share = np.array([(grade <= g).mean() for g in range(GRADES - 1)]).clip(1e-3, 1 - 1e-3)
    thresholds = np.log(share / (1 - share)) + np.arange(GRADES - 1) * 1e-3
    w = fast = np.zeros(len(buckets))
    theta, ahead, momentum = thresholds, thresholds, 1.0
    step = 4.0 / (1 + np.bincount(row, minlength=n).max())
    pad = np.array([-40.0]), np.array([40.0])
    for _ in range(steps):
        s = np.bincount(row, fast[col], n)
        edges = np.concatenate([pad[0], ahead, pad[1]])
        high, low = _sigmoid(edges[grade + 1] - s), _sigmoid(edges[grade] - s)
        p = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high) / p, low * (1 - low) / p
        by_edge = np.bincount(grade + 1, dh, GRADES + 1) - np.bincount(grade, dl, GRADES + 1)
        new_theta = np.sort(ahead + step * by_edge[1:GRADES] / n * 4)
        new_theta = np.maximum.accumulate(new_theta + np.arange(GRADES - 1) * 1e-9)
        new = fast - step * np.bincount(col, (dh - dl)[row], len(buckets)) / n * 4
        new = np.sign(new) * np.maximum(np.abs(new) - step * sparsity, 0)
        later = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        fast, ahead = new + (momentum - 1) / later * (new - w), np.sort(new_theta + (momentum - 1) / later * (new_theta - theta))
        w, theta, momentum = new, new_theta, later
    return OrdinalModel(buckets, w, theta)


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000) -> OrdinalModel | None:
    """A model fitted on at most `most_labelled` labelled documents; None if they don't hold both classes."""
    sample = docs.select("doc_id", "text").join(F.broadcast(labelled_sample(labels, "toxic", most_labelled)), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, t in text_blocks(batch):
                text, bucket = word_features(t)
                parts = np.split(bucket.astype("<u4"), np.searchsorted(text, np.arange(1, t.n)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), batch.column("label").slice(at, to - at).cast(pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["doc_id", "y", "x"])

    found = one_a_document(in_arrow(sample, run, "doc_id long, y int, x binary")).toArrow().sort_by("doc_id")
    y = found["y"].to_numpy().astype(float)
    if len(np.unique(y)) < 2:
        return None
    parts = [np.frombuffer(x.as_buffer(), "<u4") for x in found["x"]]
    return fit(np.repeat(np.arange(len(parts)), [len(x) for x in parts]), np.concatenate(parts).astype(np.int64), y)


def grade(docs: DataFrame, model: OrdinalModel | None) -> DataFrame:
    """doc_id, p_toxic, expected_severity (0 to 3), grade (most probable), toxic (p_toxic >= 0.5) of every row.

    Without a model all are 0 and false. Null and empty texts have no words and get the grades of none. Repeated
    rows repeat; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("p_toxic", pa.float64()), ("expected_severity", pa.float64()), ("grade", pa.int32()), ("toxic", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, t in text_blocks(batch):
                p = model.grades(model.linear(t)) if model else np.eye(1, GRADES).repeat(t.n, 0)
                yield record_batch(schema, batch.column(0).slice(at, to - at).cast(pa.int64()), 1 - p[:, 0], p @ np.arange(GRADES), p.argmax(1).astype(np.int32), p[:, 0] <= 0.5)

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, p_toxic double, expected_severity double, grade int, toxic boolean")
