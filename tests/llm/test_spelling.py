"""Spelling variants against all pairs by a plain edit distance."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from kavyamill.llm import spelling

DOCS = "doc_id long, text string"


def edits_one(a, b):
    """Distance exactly one, by the textbook table."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] == 1


def brute(rows):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{d}:{run}".encode()) if d is not None else 1
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [x for x in n if edits_one(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def made(seed, n_docs, alphabet="abé", lengths=(4, 5, 6, 7)):
    rng = random.Random(seed)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.choice(lengths))) for _ in range(120)]
    weight = [1.6 ** rng.randrange(12) for _ in words]
    cased = lambda w: rng.choice([w, w, w.upper().replace("É", "é"), w.title().replace("É", "é")])
    return [(i, " ".join(cased(w) for w in rng.choices(words, weight, k=rng.randrange(60)))) for i in range(n_docs)]


def found(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).repartition(4).withColumn("word", F.lit("odd")).withColumn("n", F.lit(1)).withColumn("id", F.lit(2))
    out = spelling.variants(docs)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, out.collect()))


def test_against_all_pairs(spark):
    rows = made(1, 200) + [(None, "aabba aabba aabba"), (None, None), (900, ""), (901, None), (902, "1 2 ×÷ ×÷×÷× ×÷×÷× ×÷×÷×"), (903, "ÉÉÉÉÉ ééééé ÉÉÉÉÉ ÉÉÉÉÉ ééééé ééééé")]
    rows += [(5, "baabb aabba")] * 7  # rows that repeat
    assert found(spark, rows) == brute(rows)


def test_long_words_and_long_texts(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("abcdef") for _ in range(600))
    longs = [base, base[:300] + "é" + base[301:], base[:77] + base[78:], "a" * 900, "a" * 899, "a" * 400 + "b" + "a" * 499]
    rows = [(i, " ".join(longs)) for i in range(1000, 1004)] + [(2000, "words of no length " * 20000)]
    assert found(spark, rows) == brute(rows)


def test_chains_and_ties(spark):
    counts = {"abcde": 3, "abcdf": 7, "abcdff": 15, "abcdfg": 15, "abcdfgh": 40, "bacde": 50, "zzzzz": 5}
    rows = [(7, " ".join(w for w, c in counts.items() for _ in range(c)))]
    assert found(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert found(spark, [(1, "too few")]) == [] and spelling.variants(spark.createDataFrame([], DOCS)).count() == 0
