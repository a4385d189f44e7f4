"""Quality rules: document statistics, base limits, and gradient-boosted trees over the statistics.

The trees are fitted here on a bounded sample of labelled rows, with monotonic constraints on the features that
can only speak against a text, and flattened into node arrays, so that numpy scores many rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kavyamill.llm.common import SPACE, Texts, in_arrow, labelled_sample, mix, one_a_document, record_batch, shingle_hashes, text_blocks

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
#: The statistics in order; -1: a larger value never raises the score.
FEATURES = {"log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "digit_share": 0, "mark_share": -1, "distinct_share": 0, "high_share": 0, "line_words": 0, "sentence_share": 0}

_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_UPPER, _DIGIT = np.isin(np.arange(256), range(65, 91)), np.isin(np.arange(256), range(48, 58))
_MARK = np.isin(np.arange(256), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
_STOP = np.isin(np.arange(256), list(b".!?"))
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(t: Texts) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The five counts of each text, and the features as a matrix."""
    start, end, text = t.words()
    count = lambda x: np.bincount(x, minlength=t.n).astype(np.int64)
    n_words, n_bytes = count(text), np.diff(t.bounds)
    word_chars = t.per_text(~SPACE[t.data] & ((t.data & 0xC0) != 0x80))

    newline = np.flatnonzero(t.data == 10)
    line = np.searchsorted(newline, start) + text  # rises with each new line and each new text
    first = np.flatnonzero(np.diff(line, prepend=-1))
    n_line, line_text = line[first] - text[first], text[first]
    stops = np.append(newline, len(t.data))
    line_start = np.maximum(t.bounds[line_text], np.where(n_line > 0, stops[n_line - 1] + 1, 0))
    line_end = np.minimum(t.bounds[line_text + 1], stops[n_line])
    salt = mix(np.arange(t.n, dtype=np.uint64) + np.uint64(1))
    _, kept = np.unique(t.hashes(line_start, line_end) ^ salt[line_text], return_index=True)
    n_lines = count(line_text)
    n_dup_lines = n_lines - count(line_text[kept])

    word_hash = t.hashes(start, end)
    shingles, at = shingle_hashes(word_hash, text, WINDOW)
    twice = _found_twice(shingles ^ salt[text[at]] if len(at) else shingles)
    covered = np.zeros(len(start), bool)
    for j in range(WINDOW):
        covered[at[twice] + j] = True
    n_repeat = count(text[covered])

    _, distinct = np.unique(word_hash ^ salt[text] if len(text) else word_hash, return_index=True)
    counts = dict(zip(_COUNTS, (n_words, word_chars, t.per_text(_SYMBOL[t.data]), n_dup_lines, n_repeat), strict=True))
    words, chars = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    share = lambda mask: t.per_text(mask) / np.maximum(n_bytes, 1)
    features = [np.log1p(n_words), word_chars / words, counts["n_symbols"] / chars, n_dup_lines / np.maximum(n_lines, 1), n_repeat / words, share(_UPPER[t.data]), share(_DIGIT[t.data]), share(_MARK[t.data]), count(text[distinct]) / words, share(t.data >= 0x80), np.log1p(n_words / np.maximum(n_lines, 1)), count(text[_STOP[t.data[end - 1]]] if len(end) else text) / words]
    return counts, np.stack(features, 1)


def _found_twice(values: np.ndarray) -> np.ndarray:
    order = np.argsort(values)
    same = values[order[1:]] == values[order[:-1]]
    out = np.zeros(len(values), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > REPEAT_PERCENT * n_words)


@dataclass
class Trees:
    """All trees in one node array each; a leaf is its own child."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    below: np.ndarray
    above: np.ndarray
    value: np.ndarray
    depth: int
    offset: float

    def score(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        """Log-odds of good quality for each row."""
        out = np.full(len(x), self.offset)
        for at in range(0, len(x), rows):
            part = x[at : at + rows]
            node = np.tile(self.roots, (len(part), 1))
            for _ in range(self.depth):
                node = np.where(np.take_along_axis(part, self.feature[node], 1) <= self.threshold[node], self.below[node], self.above[node])
            out[at : at + rows] += self.value[node].sum(1)
        return out


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Boosted trees with logistic loss; along a feature of sign s, s times the score never falls."""
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    score = np.full(len(y), offset := float(np.log(p / (1 - p))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], 1)
    nodes: list[list] = []
    roots = []

    def grow(rows: np.ndarray, low: float, high: float, left: int) -> int:
        g, h = gradient[rows], curve[rows]
        own = float(np.clip(g.sum() / (h.sum() + ridge), low, high))
        nodes.append([0, np.inf, len(nodes), len(nodes), own * rate])
        at, best = len(nodes) - 1, (1e-6, -1, 0, 0.0, 0.0)
        for j, c in enumerate(cuts) if left else ():
            gs = np.bincount(binned[rows, j], g, len(c) + 1).cumsum()
            hs = np.bincount(binned[rows, j], h, len(c) + 1).cumsum()
            ga, ha, gb, hb = gs[:-1], hs[:-1], gs[-1] - gs[:-1], hs[-1] - hs[:-1]
            a, b = np.clip(ga / (ha + ridge), low, high), np.clip(gb / (hb + ridge), low, high)
            gain = ga * a - (ha + ridge) * a * a / 2 + gb * b - (hb + ridge) * b * b / 2 - (g.sum() * own - (h.sum() + ridge) * own * own / 2)
            gain[(ha < 1) | (hb < 1) | (signs[j] * (b - a) < 0)] = -1
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (float(gain[k]), j, k, float(a[k]), float(b[k]))
        _, j, k, a, b = best
        if j < 0:
            score[rows] += own * rate
            return at
        split, middle = binned[rows, j] <= k, (a + b) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[signs[j]]
        nodes[at][:4] = [j, cuts[j][k], grow(rows[split], *bounds[0], left - 1), grow(rows[~split], *bounds[1], left - 1)]
        return at

    for _ in range(rounds):
        q = 1 / (1 + np.exp(-score))
        gradient, curve = y - q, q * (1 - q)
        roots.append(grow(np.arange(len(y)), -np.inf, np.inf, depth))
    feature, threshold, below, above, value = map(np.array, zip(*nodes, strict=True))
    return Trees(np.array(roots), feature, threshold, below, above, value, depth, offset)


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000) -> Trees | None:
    """Trees fitted on at most `most_labelled` labelled documents; None if they don't hold both classes."""
    sample = docs.select("doc_id", "text").join(F.broadcast(labelled_sample(labels, "quality", most_labelled)), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, t in text_blocks(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at).cast(pa.int64()), pa.array(list(statistics(t)[1]), pa.list_(pa.float64())), batch.column("label").slice(at, to - at).cast(pa.int32())], names=["doc_id", "x", "y"])

    found = one_a_document(in_arrow(sample, run, "doc_id long, x array<double>, y int")).toArrow()
    y = found["y"].to_numpy().astype(float)
    if len(np.unique(y)) < 2:
        return None
    order = np.lexsort(np.array(found["x"].to_pylist()).T)  # the same trees however the rows came
    return fit(np.array(found["x"].to_pylist())[order], y[order], list(FEATURES.values()))


def judge(docs: DataFrame, trees: Trees | None, cutoff: float = 0.0) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and score (log-odds) of every row of docs.

    kept is false where base_failed; else whether the trees' score is at least the cutoff, and true without trees.
    Null and empty texts have no words and fail. Repeated rows repeat; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in _COUNTS), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, t in text_blocks(batch):
                counts, x = statistics(t)
                failed = base_failed(counts["n_words"], counts["n_repeat_words"])
                score = trees.score(x) if trees else np.zeros(t.n)
                yield record_batch(schema, batch.column(0).slice(at, to - at).cast(pa.int64()), *counts.values(), failed, ~failed & (score >= cutoff if trees else True), score)

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")
