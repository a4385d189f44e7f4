"""The byte network: its gradients by differences, its reading by a plain loop, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kavyamill.llm import language_id as L

DOCS = "doc_id long, text string, lang string"


def plain_log_probabilities(model, window):
    """One window, byte by byte: a row for each position."""
    sides = []
    for d, order in ((model.forward, window), (model.backward, window[::-1])):
        h, out = np.zeros(d.recurrent.shape[1]), []
        for byte in order:
            z, r = (np.clip(d.inputs[g, byte] + h @ d.recurrent[g], 0, 1) for g in (0, 1))
            c = np.tanh(d.inputs[2, byte] + r * (h @ d.recurrent[2]))
            h = z * h + (1 - z) * c
            out.append(h)
        sides.append(out)
    logits = np.array([np.concatenate([f, b]) @ model.output[:-1] + model.output[-1] for f, b in zip(sides[0], sides[1][::-1], strict=True)])
    return logits - np.log(np.exp(logits).sum(1, keepdims=True))


def test_every_byte_is_read_in_one_window():
    model = L.untrained(["a", "b", "c"], seed=3)
    texts = ["", "x", "é" * 500, "abc " * 16, "long " * 3000, "y" * 64, "z" * 65]
    raw = [t.encode() for t in texts]
    p = model.pooled(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for r, found in zip(raw, p, strict=True):
        if not r:
            assert np.allclose(found, 1 / 3)
            continue
        mean = np.concatenate([plain_log_probabilities(model, r[i : i + 64]) for i in range(0, len(r), 64)]).mean(0)
        assert np.allclose(found, np.exp(mean) / np.exp(mean).sum(), atol=1e-4)


def test_gradients_by_differences():
    model, rng = L.untrained(["a", "b", "c"], hidden=3), np.random.default_rng(3)
    for d in (model.forward, model.backward):
        d.inputs, d.recurrent = d.inputs.astype(float), d.recurrent.astype(float)
    model.output = model.output.astype(float)
    length = np.array([9, 7, 7, 3, 1])
    data = rng.integers(0, 256, length.sum()).astype(np.uint8)
    args = *L.gathered(data, np.cumsum(length) - length, length), np.array([0, 1, 2, 1, 0])
    _, gradients = model.loss_and_gradients(*args)
    for p, g in zip(model.parameters(), gradients, strict=True):
        for place in zip(*np.unravel_index(np.argsort(-np.abs(g), axis=None)[:12], p.shape), strict=True):
            at, step = p[place], 1e-4
            p[place] = at + step
            high, _ = model.loss_and_gradients(*args)
            p[place] = at - step
            low, _ = model.loss_and_gradients(*args)
            p[place] = at
            assert abs((high - low) / (2 * step) - g[place]) < 1e-5


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_held_out_accuracy(docs):
    rows = L.identify(docs, L.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    kept = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in kept) >= 0.98 * len(kept)
    assert all(0 < r.score <= 1 and r.score == round(r.score, 6) for r in rows)


def test_learns_from_texts_and_langs_of_the_rest_alone(docs):
    model = L.train(docs)
    changed = docs.withColumn("source", F.lit("other")).withColumn("lang", F.when(L.held_out(), F.lit("wrong")).otherwise(F.col("lang"))).withColumn("text", F.when(L.held_out(), F.reverse("text")).otherwise(F.col("text"))).repartition(7)
    again = L.train(changed)
    assert model.languages == again.languages and all((a == b).all() for a, b in zip(model.parameters(), again.parameters(), strict=True))


def test_odd_rows(spark, docs):
    model = L.train(docs)
    odd = [(1, None, "en"), (2, "", None), (3, "12 34 ... !", "en"), (4, " \n\t", "fr"), (None, "the and of this", None), (6, "the and of this " * 60000, "en"), (6, "the and of this", "en"), (6, "the and of this", "en")]
    rows = L.identify(spark.createDataFrame(odd, DOCS).withColumn("score", F.lit(1)).withColumn("held_out", F.lit("odd")), model).collect()
    got = sorted((r.doc_id or 0, r.lang_pred, r.score) for r in rows)
    assert len(got) == len(odd) and [x[1:] for x in got if x[0] in (1, 2, 3, 4)] == [("und", 0.0)] * 4
    assert [x[1] for x in got if x[0] in (0, 6)] == ["en"] * 4 and not [r for r in rows if r.doc_id is None and r.held_out]


def test_nothing_to_learn_from(spark):
    rows = [(1, "some text", None), (2, None, "en"), (3, "", "en"), (None, "text", "en")]
    docs = spark.createDataFrame(rows, DOCS)
    assert L.train(docs) is None and L.train(spark.createDataFrame([], DOCS)) is None
    assert {(r.lang_pred, r.score) for r in L.identify(docs, None).collect()} == {("und", 0.0)}
    assert L.identify(spark.createDataFrame([], DOCS), None).count() == 0


def test_repeated_ids_count_once(spark):
    rows = [(i, "mot de la langue", "fr") for i in range(40)] + [(1, "mot de la langue", "fr")] * 500 + [(50, "the word", "en")]
    model = L.train(spark.createDataFrame(rows, DOCS).repartition(3), most_labelled=1000)
    assert set(model.languages) <= {"en", "fr"}
