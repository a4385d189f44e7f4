"""Codes against plain integers: ties, repeated rows, odd vectors, hot labels, hardly any rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kavyamill.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, entries=256, rounds=4):
    """The same from Python's own integers; rows are (vec_id, floats, label)."""
    kept = [(v, [math.floor(1024 * np.float32(x).item()) for x in e], label) for v, e, label in rows if e and None not in e and all(map(math.isfinite, e))]
    width = len(kept[0][1]) // 4
    parts = [[x[k * width : k * width + width] for _, x, _ in kept] for k in range(4)]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0], kept[i][1]))
    first = [i for i in first if kept[i][0] is not None][:entries]
    books = [[list(parts[k][i]) for i in first] for k in range(4)]

    def assigned(k):
        return [min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(books[k])) for x in parts[k]]

    for _ in range(rounds):
        for k in range(4):
            own = {}
            for x, (_, j) in zip(parts[k], assigned(k), strict=True):
                own.setdefault(j, []).append(x)
            for j, xs in own.items():
                books[k][j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = [assigned(k) for k in range(4)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = [(kept[i][0], "".join(f"{found[k][i][1]:02x}" for k in range(4)), sum(found[k][i][0] for k in range(4)), kept[i][2]) for i in range(len(kept))]
    by_label = {}
    for _, _, error, label in out:
        by_label[label] = by_label.get(label, 0) + error
    return sorted(((v, c, e, by_label[label], sha) for v, c, e, label in out), key=repr)


def made(seed, n, width=8, spread=1.0, values=None):
    rng = random.Random(seed)
    one = (lambda: rng.choice(values)) if values else (lambda: rng.gauss(0, spread))
    return [(i * 3 + 1, [one() for _ in range(width)], rng.choice([0, 0, 0, 1, 7, None])) for i in range(n)]


ODD = [(5000, None, 1), (5001, [], 1), (5002, [1.0, None] * 4, 1), (5003, [float("nan")] + [0.5] * 7, 0), (5004, [float("inf")] * 8, 0), (5005, [-float("inf")] + [0.0] * 7, None), (None, [0.25] * 8, 0), (None, [0.25] * 8, None)]


@pytest.mark.parametrize(
    "rows",
    [
        made(1, 400) + ODD,
        made(2, 90) + made(2, 90) + ODD,  # fewer than the entries, each row twice
        made(3, 280, values=[0.0, 1 / 1024, -1 / 1024]),  # ties everywhere
        made(4, 200, values=[0.0, 0.5]) + [(9, [0.5] * 8, 7)] * 200,  # a hot vector
        made(5, 350, width=4, spread=900.0),
    ],
    ids=["plain", "few", "ties", "hot", "large"],
)
def test_codes(spark, rows):
    table = spark.createDataFrame([(v, e, label) for v, e, label in rows], SCHEMA).repartition(5).withColumn("code", F.lit("odd")).withColumn("key", F.lit(1))
    wanted = brute(rows)
    for most in (50_000, 1):  # label sums broadcast, and joined
        assert sorted(map(tuple, vector_codes.compress(table, most_labels=most).collect()), key=repr) == wanted


def test_no_rows(spark):
    for rows in ([], ODD[:6]):
        out = vector_codes.compress(spark.createDataFrame(rows, SCHEMA))
        assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0


def test_other_lengths_are_left_out(spark):
    rows = made(6, 60)
    odd = [(0, [1.0] * 4, 1), (2, [1.0] * 12, 1), (3, [1.0] * 7, 1)]
    assert sorted(map(tuple, vector_codes.compress(spark.createDataFrame(rows + odd, SCHEMA)).collect()), key=repr) == brute(rows)


def test_screening_keeps_what_rounding_blurs():
    """Entries so close and so far away that float32 cannot tell them apart: the int64 pass must."""
    rng = np.random.default_rng(0)
    entries = rng.integers(1 << 24, (1 << 24) + 4, (256, 16))
    x = rng.integers(1 << 24, (1 << 24) + 4, (500, 16))
    best, distance = vector_codes.nearest(x, entries)
    every = ((x[:, None, :] - entries[None, :, :]) ** 2).sum(2)
    assert (best == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_integers_beyond_the_range_are_an_error(spark):
    with pytest.raises(Exception, match="no integer floor"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 8, 0)], SCHEMA)).collect()
