"""The draw of the quality classifier against a plain one: the same noise, the same number, the largest keys."""

import math

import numpy as np
import xxhash

from kavyamill.llm import quality_classifier as Q


def gumbel(doc_id):
    """The noise of an id, from the same hash by another implementation."""
    seed = xxhash.xxh64(b"gumbel", seed=42).intdigest()
    h = xxhash.xxh64((doc_id % (1 << 64)).to_bytes(8, "little"), seed=seed).intdigest()
    signed = h - (1 << 64) if h >> 63 else h
    uniform = (abs(math.fmod(signed, 1 << 52)) + 0.5) / (1 << 52)
    return -math.log(-math.log(uniform))


def test_the_largest_keys_are_kept(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.classify(docs, labels).collect()
    quality = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    judged = sorted((r.doc_id, r.log_weight) for r in rows if r.doc_id in quality and r.log_weight is not None)
    cutoff = Q.cutoff_of(np.array([w for _, w in judged]), np.array([quality[d] == 1 for d, _ in judged]), 0.995)
    k = sum(r.log_weight is not None and r.log_weight >= cutoff for r in rows)
    keys = {i: r.log_weight + gumbel(r.doc_id) for i, r in enumerate(rows) if r.log_weight is not None}
    assert all(abs(keys[i] - rows[i].key) < 1e-6 for i in keys)
    least = sorted(keys.values())[-k]
    assert {i for i, r in enumerate(rows) if r.kept} == {i for i, key in keys.items() if key >= least - 1e-9} and 0 < k < len(rows)


def test_the_draw_is_in_proportion_to_the_weights(spark):
    """Of many ids with two weights, the share of each among the first of pairs is that of its weight."""
    from pyspark.sql import functions as F

    n = 20000
    frame = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, math.log(3.0)).otherwise(0.0).alias("log_weight"))
    key = {r.doc_id: r.key for r in frame.select("doc_id", Q.key_of("log_weight").alias("key")).collect()}
    won = sum(key[i] > key[i + 1] for i in range(0, n, 2)) / (n / 2)
    assert abs(won - 0.75) < 0.02
