"""Language identification: a bidirectional gated recurrent network over bytes.

A text's bytes are cut into consecutive windows of WINDOW bytes. In each, one network reads from left to right and one
from right to left, both from a zero state; their states together label every position, and a document's probabilities
are the normalised geometric mean of its positions'. The weights are learned by backpropagation through time, with
Adam, from a bounded sample of windows of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kavyamill.llm.common import in_arrow, one_a_document, record_batch, text_blocks

#: Bytes that the networks read without a pause, states in each direction, and windows that are read at once.
WINDOW, HIDDEN, TOGETHER = 64, 8, 2048
UNKNOWN = "und"


@dataclass
class Direction:
    """One reading. Gates come in the order update, reset, candidate; the first two are cut to 0 and 1, not squashed."""

    inputs: np.ndarray  # gate, byte, state
    recurrent: np.ndarray  # gate, state before, state

    def step(self, h: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The state after one more byte; the two gates, the candidate's recurrent part and the candidate."""
        x, a = np.take(self.inputs, byte, axis=1, mode="clip"), np.matmul(h, self.recurrent)
        gates, inner = a[:2], a[2]
        gates += x[:2]
        np.clip(gates, 0, 1, out=gates)
        candidate = inner * gates[1]
        candidate += x[2]
        np.tanh(candidate, out=candidate)
        new = h - candidate
        new *= gates[0]
        new += candidate
        return new, gates, inner, candidate

    def states(self, bytes_: np.ndarray, active: np.ndarray, backward: bool, kept: list | None = None) -> np.ndarray:
        """State after each position: position, window, state. bytes_ are position by window, windows from long to
        short, so that those which hold position t are the first active[t]. kept: gets what gradients() needs."""
        out = np.zeros((*bytes_.shape, self.recurrent.shape[1]), self.inputs.dtype)
        h = np.zeros(out.shape[1:], out.dtype)
        for t in range(len(active))[:: -1 if backward else 1]:
            n = active[t]
            before = h[:n] if kept is None else h[:n].copy()
            out[t, :n], *inside = self.step(before, bytes_[t, :n])
            h[:n] = out[t, :n]
            if kept is not None:
                kept.append((t, before, *inside))
        return out

    def gradients(self, bytes_: np.ndarray, active: np.ndarray, kept: list, wrong: np.ndarray) -> list[np.ndarray]:
        """Gradients of inputs and recurrent from those of each position's state, back through time."""
        d_recurrent, seen, pre = np.zeros_like(self.recurrent), [], []
        dh = np.zeros(wrong.shape[1:], wrong.dtype)
        for t, h, gates, inner, candidate in reversed(kept):
            n = active[t]
            d = dh[:n] + wrong[t, :n]
            d_candidate = d * (1 - gates[0]) * (1 - candidate * candidate)
            d_gates = np.stack([d * (h - candidate), d_candidate * inner]) * ((gates > 0) & (gates < 1))
            d_inner = np.concatenate([d_gates, (d_candidate * gates[1])[None]])
            d_recurrent += np.matmul(h.T, d_inner)
            dh[:n] = d * gates[0] + np.matmul(d_inner, self.recurrent.transpose(0, 2, 1)).sum(0)
            seen.append(bytes_[t, :n])
            pre.append(np.concatenate([d_gates, d_candidate[None]]))
        byte, by_input = np.concatenate(seen), np.concatenate(pre, axis=1)
        d_inputs = np.stack([np.stack([np.bincount(byte, column, 256) for column in gate.T], axis=1) for gate in by_input])
        return [d_inputs.astype(self.inputs.dtype), d_recurrent]


@dataclass
class LanguageModel:
    languages: list[str]
    forward: Direction
    backward: Direction
    output: np.ndarray  # forward and backward states and a one, language

    def parameters(self) -> list[np.ndarray]:
        return [self.forward.inputs, self.forward.recurrent, self.backward.inputs, self.backward.recurrent, self.output]

    def log_probabilities(self, states: np.ndarray) -> np.ndarray:
        """Of each language at each position, language first; states: position, both directions' states."""
        logits = np.ascontiguousarray((states @ self.output[:-1]).T)
        logits += self.output[-1][:, None]
        logits -= logits.max(0)
        logits -= np.log(np.exp(logits).sum(0))
        return logits

    def loss_and_gradients(self, bytes_: np.ndarray, active: np.ndarray, language: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean negative log-likelihood of all positions' languages, each window having one, and its gradients."""
        kept: tuple[list, list] = [], []
        both = np.concatenate([self.forward.states(bytes_, active, False, kept[0]), self.backward.states(bytes_, active, True, kept[1])], axis=2)
        held = np.arange(bytes_.shape[1])[None, :] < active[:, None]
        states = both[held]
        log_p = self.log_probabilities(states)
        at = np.broadcast_to(language, held.shape)[held], np.arange(len(states))
        wrong = np.exp(log_p)
        wrong[at] -= 1
        wrong /= len(states)
        d_both = np.zeros_like(both)
        d_both[held] = wrong.T @ self.output[:-1].T
        n = self.forward.recurrent.shape[1]
        d_output = np.concatenate([states.T @ wrong.T, wrong.sum(1)[None]])
        return -float(log_p[at].mean()), [*self.forward.gradients(bytes_, active, kept[0], d_both[:, :, :n]), *self.backward.gradients(bytes_, active, kept[1], d_both[:, :, n:]), d_output]

    def pooled(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Probabilities of each text's languages: text i is data[bounds[i]:bounds[i + 1]]. An empty text's are equal."""
        n = len(bounds) - 1
        start, length, text = windows(bounds)
        total = np.zeros((n, len(self.languages)))
        for at in range(0, len(start), TOGETHER):
            part = at + np.argsort(-length[at : at + TOGETHER], kind="stable")
            bytes_, active = gathered(data, start[part], length[part])
            f, b = self.forward.states(bytes_, active, False), self.backward.states(bytes_, active, True)
            by_window = np.zeros((len(self.languages), len(part)), np.float32)
            for t, m in enumerate(active):
                by_window[:, :m] += self.log_probabilities(np.concatenate([f[t, :m], b[t, :m]], axis=1))
            for k, of_language in enumerate(by_window):
                total[:, k] += np.bincount(text[part], of_language, n)
        mean = total / np.maximum(np.diff(bounds), 1)[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of each window: every byte of every text is in exactly one."""
    n = -(-np.diff(bounds) // WINDOW)
    text = np.repeat(np.arange(len(n)), n)
    start = bounds[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    return start, np.minimum(bounds[text + 1] - start, WINDOW), text


def gathered(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes, position by window, and how many windows hold each position; windows come from long to short."""
    places = np.minimum(start[None, :] + np.arange(length[0])[:, None], len(data) - 1)
    return data[places], np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")


def untrained(languages: list[str], seed: int = 0, hidden: int = HIDDEN) -> LanguageModel:
    rng = np.random.default_rng(seed)

    def made(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    def direction() -> Direction:
        half_open = np.float32([[[0.5]], [[0.5]], [[0.0]]])
        return Direction(made(3, 256, hidden, scale=0.15) + half_open, made(3, hidden, hidden, scale=0.3 / np.sqrt(hidden)))

    return LanguageModel(languages, direction(), direction(), made(2 * hidden + 1, len(languages), scale=0.3))


def fit(pieces: list[bytes], language: np.ndarray, languages: list[str], steps: int = 200, batch: int = 256, rate: float = 0.02) -> LanguageModel:
    """A model learned from windows, each in one language, by Adam with a rate that falls to zero; the same each time."""
    model = untrained(languages)
    rng = np.random.default_rng(1)
    data, length = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(x) for x in pieces])
    start = np.cumsum(length) - length
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parameters()]
    waiting = np.zeros(0, np.int64)
    for step in range(steps):
        if len(waiting) < min(batch, len(pieces)):
            waiting = np.concatenate([waiting, rng.permutation(len(pieces))])
        chosen, waiting = waiting[:batch], waiting[batch:]
        chosen = chosen[np.argsort(-length[chosen], kind="stable")]
        _, gradients = model.loss_and_gradients(*gathered(data, start[chosen], length[chosen]), language[chosen])
        norm = max(1.0, np.sqrt(sum(float((g * g).sum()) for g in gradients)))
        now = np.float32(rate * (1 - step / steps) * np.sqrt(1 - 0.999 ** (step + 1)) / (1 - 0.9 ** (step + 1)))
        for p, (first, second), g in zip(model.parameters(), moments, gradients, strict=True):
            g = g / np.float32(norm)
            first += np.float32(0.1) * (g - first)
            second += np.float32(0.001) * (g * g - second)
            p -= now * first / (np.sqrt(second) + np.float32(1e-8))
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: the checksum of its id as text leaves 2 when divided by 4; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, most_labelled: int = 2_000, most_windows: int = 8) -> LanguageModel | None:
    """A model fitted on at most `most_labelled` documents that have a lang and aren't held out, and on at most
    `most_windows` windows of each, evenly spread over its whole text; None if there is no such document with a text.

    The documents are those whose ids have the least hashes, the same for any partitioning. A row without doc_id takes
    no part, and of rows with one doc_id the least counts.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("pieces", pa.list_(pa.binary()))])
    rows = docs.where("lang is not null and doc_id is not null and text <> ''").where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(most_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, t in text_blocks(batch):
                start, length, text = windows(t.bounds)
                n, first = np.bincount(text, minlength=t.n), np.searchsorted(text, np.arange(t.n))
                spread = [first[i] + np.unique(np.linspace(0, n[i] - 1, min(n[i], most_windows)).round().astype(np.int64)) for i in range(t.n)]
                pieces = [[t.data[start[k] : start[k] + length[k]].tobytes() for k in places] for places in spread]
                yield record_batch(schema, batch.column("doc_id").slice(at, to - at), batch.column("lang").slice(at, to - at), pieces)

    found = one_a_document(in_arrow(rows.join(F.broadcast(chosen), "doc_id"), run, "doc_id long, lang string, pieces array<binary>")).toArrow().sort_by("doc_id")
    if not found.num_rows:
        return None
    langs, pieces = found["lang"].to_pylist(), found["pieces"].to_pylist()
    languages = sorted(set(langs))
    return fit([x for own in pieces for x in own], np.repeat([languages.index(x) for x in langs], [len(own) for own in pieces]), languages)


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred (a learned language) and score (its pooled probability, 0 to 1, six places) of every row.

    Whole texts are read. A null text, or one without any letter, gets `und` and 0, as all do without a model. Of equal
    probabilities the first language in order wins. Repeated rows repeat; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*(model.languages if model else []), UNKNOWN], object)
        for batch in batches:
            known = batch.column("text").is_valid().to_numpy(zero_copy_only=False) & (model is not None)
            for at, to, t in text_blocks(batch):
                p = model.pooled(t.data, t.bounds) if model else np.zeros((t.n, 1))
                best = np.where(known[at:to], p.argmax(1), len(names) - 1)
                score = np.where(known[at:to], p.max(1).round(6), 0.0)
                yield record_batch(schema, batch.column("doc_id").slice(at, to - at), batch.column("held_out").slice(at, to - at), names[best], score)

    return in_arrow(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")
