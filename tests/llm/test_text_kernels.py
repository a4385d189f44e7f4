"""Numpy kernels against plain Python."""

import base64
import collections
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from kavyamill.llm import byte_bpe, line_dedup, near_dedup, quality_classifier, quality_rules, toxicity
from kavyamill.llm.common import Texts

ODD = st.text(alphabet=st.sampled_from(list("ab cAB'st\n\t 12\x1c\x1d\x85\xa0 é漢😀ñ..!!#|<-　﻿\x0b́")), max_size=80)


@pytest.fixture(scope="module")
def pairs():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ours = byte_bpe.BytePairs(byte_bpe.read_ranks(path), public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    return ours, theirs


def test_bpe_equals_the_library(pairs):
    ours, theirs = pairs

    @settings(max_examples=400, deadline=None)
    @given(ODD)
    def same(text):
        ids = ours.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text)
        assert ours.decode(ids) == text.encode()

    same()
    for text in ("", "a" * 5000, " " * 3000, "ab" * 4000, "\n" * 999 + "x", "<|endoftext|>", "ünïcödé " * 200, "漢字" * 500):
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == theirs.encode_ordinary(text)


def statistics(text):
    word = re.compile("[^\x20\x09-\x0D]+")
    words = word.findall(text)
    seen, duplicates = set(), 0
    for line in (x for x in text.split("\n") if word.search(x)):
        duplicates += line in seen
        seen.add(line)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=6), st.integers(1, 5))
def test_statistics(texts, times):
    texts = [x * times for x in texts] + ["", "a b\n\n a b\na b\r\n"]
    counts, features = quality_rules.statistics(Texts.of(texts))
    assert list(zip(*[c.tolist() for c in counts.values()], strict=True)) == [statistics(x) for x in texts]
    assert np.isfinite(features).all()


def test_trees_keep_their_signs():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality_rules.FEATURES)))
    y = (x[:, 1] + 0.5 * np.sin(9 * x[:, 4]) - x[:, 2] + 0.2 * rng.standard_normal(3000) > 0).astype(float)
    signs = list(quality_rules.FEATURES.values())
    trees = quality_rules.fit(x, y, signs)
    assert ((trees.score(x) > 0) == y).mean() > 0.8
    for j, sign in enumerate(signs):
        if sign:
            grid = np.tile(x[:50, None, :], (1, 20, 1))
            grid[:, :, j] = np.linspace(0, 1, 20)
            steps = np.diff(trees.score(grid.reshape(-1, x.shape[1])).reshape(50, 20), axis=1)
            assert (sign * steps >= -1e-9).all()


def test_ordinal_model_orders_grades():
    rng = np.random.default_rng(1)
    bad = [f"bad{i}" for i in range(8)]
    texts, toxic = [], []
    for i in range(1500):
        n = int(rng.choice([0, 0, 0, 1, 3, 6]))
        words = [f"w{k}" for k in rng.integers(0, 3000, 40)] + list(rng.choice(bad, n))
        texts.append(" ".join(words).replace("bad", "bad x").replace(" x", "q"))
        toxic.append(float(n > 0))
    t = Texts.of([re.sub(r"\d+", lambda m: "".join(chr(97 + int(c)) for c in m[0]), x) for x in texts])
    row, bucket = toxicity.word_features(t)
    model = toxicity.fit(row, bucket, np.array(toxic))
    p = model.grades(model.linear(t))
    assert np.allclose(p.sum(1), 1) and (np.diff(model.thresholds) >= 0).all()
    assert ((p[:, 0] < 0.5) == (np.array(toxic) > 0)).mean() > 0.97


def multiset(text, k=5):
    w = text.split()
    return collections.Counter([tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([tuple(w)] if w else []))


def jaccard(a, b):
    whole = sum((a | b).values())
    return sum((a & b).values()) / whole if whole else 0.0


def test_dart_minhash_estimates_weighted_jaccard():
    rng = random.Random(2)
    base = [rng.choice("abcdefghijklmnop") * 3 + str(rng.randrange(50)) for _ in range(300)]
    texts = []
    for p in (0.0, 0.01, 0.03, 0.1):
        texts += [" ".join(base + base[:80]), " ".join(w if rng.random() > p else "zz" + str(rng.random()) for w in base + base[:80])]
    texts += ["one two", "one two", "a a a a a a a a a a", "a a a a a a a"]
    t = Texts.of(texts)
    exact = [jaccard(multiset(a), multiset(b)) for a, b in zip(texts[::2], texts[1::2], strict=True)]
    assert np.allclose(near_dedup.similarities(t), exact)
    shingle, text = near_dedup.elements(t)
    signature = near_dedup.dart_minhash(near_dedup.regions(shingle, text), text, t.n, 2000)
    assert np.isfinite(signature).all()
    assert np.allclose((signature[::2] == signature[1::2]).mean(1), exact, atol=0.05)


def test_line_signatures():
    lines = ["the quick brown fox jumps over the lazy dog again", "the quick brown fox jumps over the lazy cat again", "an entirely other line of text, with éàü in it"]
    exact = [len(a & b) / len(a | b) for a, b in [({x[i : i + 8] for i in range(len(x) - 7)}, {y[i : i + 8] for i in range(len(y) - 7)}) for x in lines for y in lines]]
    found = line_dedup.similarities([x for x in lines for _ in lines], lines * 3)
    assert np.allclose(found, exact)
    assert (line_dedup.signatures(lines) == line_dedup.signatures(lines[::-1])[::-1]).all()


def test_ngrams_do_not_depend_on_the_block():
    texts = ["Foo bar!! 12 foo", "", "x", "###", "Foo bar!! 12 foo", "ÀB cd"]
    text, bucket = quality_classifier.ngrams(Texts.of(texts))
    for i, one in enumerate(texts):
        _, alone = quality_classifier.ngrams(Texts.of([one]))
        assert sorted(bucket[text == i]) == sorted(alone)


def test_similar_pairs_and_orders():
    from kavyamill.llm import banding

    for seed in range(20):
        r = np.random.default_rng(seed)
        base = [set(r.integers(0, 60, r.integers(0, 30)).tolist()) for _ in range(4)]
        sets = [{x for x in base[r.integers(4)] if r.random() < 0.93} | set(r.integers(0, 60, r.integers(0, 2)).tolist()) for _ in range(r.integers(2, 40))]
        h, owner = np.array([x for s in sets for x in s], np.uint64), np.array([i for i, s in enumerate(sets) for _ in s], np.int64)
        rows = np.flatnonzero(r.random(len(sets)) < 0.4)
        found = {(int(i), int(j)) for left, right in banding.similar_pairs(h, owner, rows, len(sets), 0.8) for i, j in zip(left, right, strict=True) if i != j}
        assert found == {(int(i), j) for i in rows for j, s in enumerate(sets) if i != j and (sets[i] | s) and len(sets[i] & s) >= 0.8 * len(sets[i] | s)}
        values, ids = r.integers(0, 50, 300, dtype=np.uint64), r.integers(0, 9, 300)
        assert (banding.stable_order(values) == np.argsort(values, kind="stable")).all()
        order, _, _ = banding.star(values, ids)
        assert list(zip(values[order], ids[order], strict=True)) == sorted(zip(values, ids, strict=True))


def test_small_groups_by_squares():
    """Pairs of sets within groups by Jaccard similarity, against sets."""
    from kavyamill.llm.banding import similar_in_groups

    rng = np.random.default_rng(4)
    sizes = np.array([1, 2, 5, 32, 3, 1])
    starts = np.cumsum(sizes) - sizes
    base = [rng.integers(0, 60, 40) for _ in sizes]
    sets = [np.concatenate([x[rng.random(40) < 0.97], rng.integers(0, 500, rng.integers(0, 4)), x[:5]]) for x, n in zip(base, sizes, strict=True) for _ in range(n)]
    sets[3] = np.zeros(0, np.int64)
    h, owner = np.concatenate(sets).astype(np.uint64), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    group = np.repeat(np.arange(len(sizes)), sizes)
    held = [set(x.tolist()) for x in sets]
    wanted = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if group[i] == group[j] and held[i] | held[j] and len(held[i] & held[j]) >= 0.8 * len(held[i] | held[j])}
    i, j = similar_in_groups(h, owner, starts, sizes, 0.8)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == wanted and len(i) == len(wanted) > 5
    assert len(similar_in_groups(h[:0], owner[:0], starts, sizes, 0.8)[0]) == 0
