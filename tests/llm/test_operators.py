"""Operators on small tables against brute force: nulls, empty and long texts, ties, repeated rows, no rows, odd columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kavyamill.llm import byte_bpe, decontaminate, graph, licenses, line_dedup, near_dedup, quality_classifier, quality_rules, substring_dedup, toxicity, url_filter

DOCS = "doc_id long, text string"
ODD_TEXTS = ["", None, "  ", "", " ", "x", "x", "a a a a a a a a a a", "a a a a a a a a a a a", None]


def union_find(n, edges):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def made_texts(seed, sizes, rates):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    out = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice(sizes))]
        for _ in range(rng.randrange(1, 7)):
            rate = rng.choice(rates)
            out.append(" ".join(rng.choice(vocabulary) if rng.random() < rate else w for w in base))
    return out


def frame(spark, texts, schema=DOCS):
    return spark.createDataFrame(list(enumerate(texts)), schema).repartition(5).withColumn("label", F.lit("odd")).withColumn("key", F.lit(1)).withColumn("component", F.lit(2))


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(0, i) for i in range(300, 400)] + [(400 + i, 401 + i) for i in range(60)] + [(None, 3), (5, 5)]
    found = dict(map(tuple, graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    wanted = union_find(500, [e for e in edges if None not in e])
    linked = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    assert found == {x: wanted[x] for x in linked}
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def multiset(text):
    w = (text or "").split()
    return collections.Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else []))


def similar(a, b):
    whole = sum((a | b).values())
    return bool(whole) and sum((a & b).values()) / whole >= 0.8


def test_near_duplicates(spark):
    texts = made_texts(5, [3, 6, 40, 100, 300], [0, 0.005, 0.01, 0.02, 0.03, 0.06]) + ODD_TEXTS + ["long " + "w%d " * 3 % (1, 2, 3) * 20000] * 2
    sets = [multiset(x) for x in texts]
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if texts[i] is not None and texts[j] is not None and (texts[i] == texts[j] or similar(sets[i], sets[j]))]
    found = dict(map(tuple, near_dedup.near_duplicates(frame(spark, texts)).collect()))
    assert found == dict(enumerate(union_find(len(texts), edges)))
    assert near_dedup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_near_copies_around_the_threshold(spark):
    """A group in which each is near the border of some others: stars alone would leave it in pieces."""
    texts = made_texts(9, [120], [0.01, 0.02, 0.025])
    rng = random.Random(1)
    base = [f"v{rng.randrange(900)}" for _ in range(150)]
    texts += [" ".join(f"z{rng.random()}" if rng.random() < 0.028 else w for w in base) for _ in range(70)]
    sets = [multiset(x) for x in texts]
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if similar(sets[i], sets[j])]
    found = dict(map(tuple, near_dedup.near_duplicates(frame(spark, texts)).collect()))
    assert found == dict(enumerate(union_find(len(texts), edges)))


def test_line_dedup(spark):
    rng = random.Random(3)
    lines = made_texts(7, [3, 8, 20, 40], [0, 0, 0.02, 0.04, 0.08]) + ["é" * 30, "ñandú " * 9]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 8))) for _ in range(80)] + [None, "", "\n\n", " " * 50 + "\n" + " " * 50, "short\nshort"]
    held = [(d, n, x) for d, t in enumerate(texts) for n, x in enumerate((t or "").split("\n")) if line_dedup.compared(x)]
    sets = [{x[i : i + 8] for i in range(len(x) - 7)} for _, _, x in held]
    edges = [(i, j) for i in range(len(held)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    wanted = collections.defaultdict(list)
    for i, (root, (d, n, _)) in enumerate(zip(union_find(len(held), edges), held, strict=True)):
        if root != i:
            wanted[d].append(n)
    rows = line_dedup.dedup_lines(frame(spark, texts)).collect()
    assert {r.doc_id: r.removed for r in rows if r.removed} == dict(wanted)
    assert [r.n_lines for r in sorted(rows, key=lambda r: r.doc_id)] == [0 if t is None else len(t.split("\n")) for t in texts]
    docs = frame(spark, texts)
    cut = {r.doc_id: r.text for r in line_dedup.without(docs, line_dedup.removed_lines(docs)).collect()}
    assert cut == {d: t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in wanted.get(d, ())) for d, t in enumerate(texts)}
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def brute_cut(raws, n=400):
    count = collections.Counter(r[i : i + n] for r in raws for i in range(len(r) - n + 1))
    for r in raws:
        mark = np.zeros(len(r) + 1, int)
        for i in range(len(r) - n + 1):
            if count[r[i : i + n]] > 1:
                mark[i] += 1
                mark[i + n] -= 1
        gone = np.cumsum(mark)[:-1] > 0
        runs = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        yield len(r), int(gone.sum()), len(runs) // 2, hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest()


@pytest.mark.parametrize("seed", [0, 1])
def test_substring_dedup(spark, seed):
    rng = random.Random(seed)
    made = lambda n: "".join(rng.choice("abcd efghé\n") for _ in range(n))
    passages = [made(rng.randrange(380, 1500)) for _ in range(12)]
    texts = []
    for _ in range(100):
        t = ""
        for _ in range(rng.randrange(1, 4)):
            kind, p, at = rng.random(), rng.choice(passages), rng.randrange(0, 200)
            t += (p[at:] if rng.random() < 0.5 else p[: len(p) - at]) if kind < 0.45 else made(rng.choice([1, 2, 3, 7, 50])) * rng.randrange(1, 900) if kind < 0.55 else made(rng.randrange(0, 900))
        texts.append(t[:6000])
    texts += [texts[3], texts[5] + "x", "", "a" * 399, "b" * 400, "b" * 400, "c" * 401, None, "d" * 1000]
    found = sorted(map(tuple, substring_dedup.digests(substring_dedup.dedup(frame(spark, texts))).collect()))
    assert found == [(i, *x) for i, x in enumerate(brute_cut([(t or "").encode() for t in texts]))]
    assert substring_dedup.dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_long_text_is_cut_in_pieces(spark, monkeypatch):
    rng = random.Random(4)
    half = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    texts = [half + "".join(rng.choice("ijkl") for _ in range(5000)) + half, half[100:700]]
    monkeypatch.setattr(substring_dedup, "PIECE", 4096)
    keys, found = [], 0
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(texts)], names=["k", "text"])
    for k, base, t in substring_dedup._pieces(batch):
        keys.append((len(k), int(base[0]), len(t.data)))
        found += substring_dedup.block_anchors(t) is not None
    assert found == len(keys) and max(b for _, b, _ in keys) > 10000


def test_license_scan(spark):
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(n))
    notices = list(licenses.TEMPLATES.items())
    rows = []
    for i in range(60):
        name, text = notices[i % len(notices)]
        parts = text.split()
        if i % 3 == 1 and len(parts) > 30:
            parts[len(parts) // 2] = "changed"
        rows.append((i, words(rng.randrange(0, 90)) + " " + " ".join(parts).upper() + ", " + words(rng.randrange(0, 60)), name))
    rows += [(100, "license licensed released restriction", None), (101, None, None), (102, "", None), (103, words(3000), None), (104, "Released under the MIT", None)]
    docs = spark.createDataFrame([r[:2] for r in rows], DOCS)
    found = collections.defaultdict(dict)
    for r in licenses.scan(docs.withColumn("license_id", F.lit("odd")).withColumn("value", F.lit(1))).collect():
        found[r.doc_id][r.license_id] = r.containment
    for doc_id, _, name in rows:
        assert (name in found[doc_id]) if name else not found[doc_id], (doc_id, name)
    clean = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    for doc_id, text, _ in rows:  # nothing is found that the whole document doesn't hold
        w = clean(text)
        have = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for name, share in found[doc_id].items():
            t = licenses.template_words(licenses.TEMPLATES[name])
            wanted = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
            assert 0.8 <= share <= len(have & wanted) / len(wanted) + 1e-9
    assert licenses.scan(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs, {"short": "only four words here"})


def test_url_filter(spark):
    pages = [(1, "http://a.com/x?y#z", '<link href="https://b.example.com/de/1" rel="canonical">'), (2, "https://b.example.com/de/1", None), (3, "HTTP://C.org/fr/", '<meta http-equiv="refresh" content="0; url=http://d.edu/1">'), (4, "http://d.edu/1", ""), (5, "http://e.edu/q", "<link rel=canonical href=/r>"), (6, "http://e.edu/r", '<link rel="canonical" href="//a.com/x?y">'), (7, None, None), (8, "net/x", ""), (9, "http://X.Example.NET/en/a", ""), (10, "ftp://net", ""), (11, "http://net/", ""), (11, "http://net/", ""), (12, "http://planet/", "canonical")]
    found = {r.page_id: tuple(r)[1:5] for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("key", F.lit(0))).collect()}
    assert found == {1: ("a.com", "/x", None, "block"), 2: ("b.example.com", "/de/1", "example.com/de/", "block"), 3: ("c.org", "/fr/", "org/fr/", "allow"), 4: ("d.edu", "/1", None, "allow"), 5: ("e.edu", "/q", None, "block"), 6: ("e.edu", "/r", None, "block"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("x.example.net", "/en/a", "example.net/en/", "allow"), 10: ("net", "", None, "allow"), 11: ("net", "/", "net/", "block"), 12: ("planet", "/", None, "allow")}
    extra = spark.createDataFrame([("http://q.com/", "http://a.net/"), ("http://q.com/", "http://ok.example.net/en/")], "url string, target string")
    one = spark.createDataFrame([(1, "http://q.com/", None)], "page_id long, url string, html string")
    assert url_filter.judge(one, redirects=extra).first().verdict == "allow"  # allow comes before block
    assert url_filter.judge(one.where("false")).count() == 0


BENCH = "If Alice buys 3 apples for 5 kg each and Bob buys 3 pears, how many apples does Alice have in total today"


def test_decontamination(spark, monkeypatch):
    docs = [(1, "foo bar. If Carol buys 7 apples for 9kg each and Dan buys 7 pears, how many apples does Carol have in total today. more"), (2, "If Carol buys 7 apples for 9 kg each and Dan buys 8 pears, how many apples does Carol have in total today"), (3, BENCH), (4, None), (5, ""), (6, "how many apples does Alice have in total today"), (7, BENCH.upper() + "!!"), (8, ("filler words go here " * 500) + BENCH + (" and more filler words" * 500)), (9, "a b c d")]
    items = spark.createDataFrame([(1, BENCH), (2, "too short an item"), (3, None)], "item_id long, text string")
    frame_of = spark.createDataFrame(docs, DOCS).withColumn("h", F.lit(1)).withColumn("item", F.lit(2))
    wanted = {1: (True, True), 2: (False, True), 3: (True, False), 7: (True, False), 8: (True, False)}
    for most in (decontaminate.MAX_LOOKUP, 1):
        monkeypatch.setattr(decontaminate, "MAX_LOOKUP", most)
        found = {r.doc_id: (r.leak, r.changed) for r in decontaminate.leaks(frame_of, items).collect() if r.item_id == 1}
        assert {k: v for k, v in found.items() } == wanted
    assert decontaminate.leaks(frame_of, items.where("false")).count() == 0
    assert decontaminate.leaks(frame_of.where("false"), items).count() == 0


def test_models_without_labels_or_rows(spark):
    docs = frame(spark, ODD_TEXTS + ["some plain words here for a text of ten words or more"] * 2)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.train(docs, labels) is None and toxicity.train(docs, labels) is None
    judged = {r.doc_id: r.kept for r in quality_rules.judge(docs, None).collect()}
    assert judged == {i: i >= len(ODD_TEXTS) for i in range(len(ODD_TEXTS) + 2)}
    assert {r.toxic for r in toxicity.grade(docs, None).collect()} == {False}
    kept = {r.doc_id: r.kept for r in quality_classifier.classify(docs, labels).collect()}
    assert kept == {i: bool((x or "").strip()) for i, x in enumerate([*ODD_TEXTS, "x", "x"])}
    assert quality_classifier.select_good(docs, labels).columns == docs.columns
    assert quality_rules.judge(docs.where("false"), None).count() == 0
    assert quality_classifier.classify(docs.where("false"), labels).count() == 0


def test_kth_largest(spark):
    rng = random.Random(8)
    values = [rng.gauss(0, 100) for _ in range(500)] + [3.5] * 40
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 7, 250, 300, 540):
        assert quality_classifier.kth_largest(df, "x", k, 8) == sorted(values, reverse=True)[k - 1]


def test_held_out_accuracy(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    fitted, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    share = lambda df, a, b: df.join(held, "doc_id").agg(F.avg((F.expr(a) == (F.col(b) == 1)).cast("int"))).first()[0]
    assert share(quality_classifier.classify(docs, fitted), "kept", "quality") > 0.95
    assert share(quality_rules.judge(docs, quality_rules.train(docs, fitted)).where("not base_failed"), "kept", "quality") > 0.95
    assert share(toxicity.grade(docs, toxicity.train(docs, fitted)).withColumnRenamed("toxic", "bad"), "bad", "toxic") > 0.93


def test_bpe_rows(spark):
    import public_tokenizers as public

    rows = byte_bpe.encode_digests(frame(spark, ["", None, "ab", "ab", "é" * 70000]), public.path("byte_bpe_50k.tiktoken"), public.PATTERN).collect()
    by = {r.doc_id: r for r in rows}
    assert by[0].n_tokens == by[1].n_tokens == 0 and by[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[2].ids_sha256 == by[3].ids_sha256 and by[4].decoded_sha256 == hashlib.sha256(("é" * 70000).encode()).hexdigest()


def cut_rows(spark, rows):
    found = substring_dedup.digests(substring_dedup.dedup(spark.createDataFrame(rows, DOCS).repartition(3))).collect()
    return sorted(map(tuple, found), key=repr), sorted(((i, *x) for (i, _), x in zip(rows, brute_cut([(t or "").encode() for _, t in rows]), strict=True)), key=repr)


def test_substring_dedup_against_periodic_texts(spark):
    rng = random.Random(5)
    made = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, long_line, odd = made(60), made(190), made(77)
    texts = [line * 20, line * 7, "=" * 5000, "=" * 400, made(300) + long_line * 9 + made(500), long_line[50:] + long_line * 2, odd * 6 + made(30), odd[20:] + odd * 4 + odd[:40]]
    texts += [made(100) + "-" * 470 + made(100), made(50) + "-" * 400 + made(70), made(10) + line * 7 + made(30), (made(200) * 2) + made(300), made(400) + "-" * 399]
    found, wanted = cut_rows(spark, list(enumerate(texts)))
    by_id = {x[0]: x for x in wanted}
    assert found == wanted and by_id[1][1:3] == (420, 420) and by_id[3][1:3] == (400, 400)


@pytest.mark.parametrize("seed", range(3))
def test_settled_runs_still_ask(seed):
    """Every string of a settled run lies in the context of an anchor that is sent."""
    rng = random.Random(seed)
    made = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = [made(rng.randrange(0, 300)) + made(rng.choice([1, 2, 7, 60, 150, 200])) * rng.randrange(3, 500) + made(rng.randrange(0, 300)) for _ in range(20)]
    for text in texts:
        raw = text.encode()[:8000]
        t = substring_dedup.Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        found = substring_dedup.block_anchors(t)
        if found is None:
            continue
        held = set()
        for at in found[3].tolist():
            held |= {raw[i : i + 400] for i in range(max(0, at - 200), min(at, len(raw) - 400) + 1)}
        assert all(raw[i : i + 400] in held for i in range(len(raw) - 399))


def test_substring_dedup_of_repeated_rows(spark):
    rng = random.Random(6)
    made = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    long, short, shared = made(1500), made(420), made(450)
    rows = [(1, short), (1, short), (2, long), (2, long), (2, long), (None, shared), (None, shared), (3, shared + made(200)), (4, made(399)[:390]), (5, made(700)), (6, long[100:520])]
    rows += [(7, "a" * 399), (7, "a" * 399), (8, "b" * 400), (8, "b" * 400), (9, None), (9, None), (10, made(900))]
    found, wanted = cut_rows(spark, rows)
    assert found == wanted


def test_substring_dedup_of_a_crowd(spark, monkeypatch):
    """A passage in very many different surroundings is compared in groups of bounded size."""
    rng = random.Random(9)
    made = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    short, long, odd, near = made(360), made(640), made(430), made(900)
    texts = [made(rng.randrange(0, 250)) + p + made(rng.randrange(0, 450)) for p in (short, long, odd) for _ in range(150)]
    texts += [made(100) + "-" * rng.randrange(380, 480) + made(100) for _ in range(60)]
    texts += [near[:i] + "x" + near[i + 1 :] for i in rng.sample(range(900), 100)] + [texts[0], texts[200], texts[200]]
    seen, compared = [], substring_dedup.compared
    monkeypatch.setattr(substring_dedup, "CROWD", 30)
    monkeypatch.setattr(substring_dedup, "compared", lambda context: seen.append(context) or compared(context))
    found, wanted = cut_rows(spark, [*enumerate(texts), (400, texts[400]), (None, texts[160])])
    assert found == wanted
    assert seen[0].groupBy("part", "side").count().agg(F.max("count")).first()[0] <= 30


def test_line_dedup_of_short_lines(spark, tmp_path):
    from kavyamill.llm import queries

    rng = random.Random(8)
    lines = made_texts(9, [1, 2, 3, 4], [0, 0, 0.2]) + ["x", "aaaaaaaa", "aaaaaaaaa", "aaaaaaa", "abcdefghijk", "abcdefghijkl", "abcdefghijklm", "é", "All rights reserved.", "short", " short"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 8))) for _ in range(80)] + [None, "", "\n\n", " ", "x\nx", "abcdefghijkl\nabcdefghijklm\nabcdefghijk"]
    held = [(d, n, x) for d, t in enumerate(texts) for n, x in enumerate((t or "").split("\n")) if x and not x.isspace()]
    sets = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for _, _, x in held]
    edges = [(i, j) for i in range(len(held)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    wanted = collections.defaultdict(list)
    for i, (root, (d, n, _)) in enumerate(zip(union_find(len(held), edges), held, strict=True)):
        if root != i:
            wanted[d].append(n)
    frame(spark, texts).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op8_line_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.removed for r in found if r.removed} == dict(wanted)


def test_decontamination_of_names_and_values(spark, monkeypatch):
    clips = "Natalia sold 48 clips to her friends in April. Natalia then sold 24 clips in May. How many clips did Natalia sell altogether in April and May?"
    anna = "On monday Anna buys 5 red pens and 7 blue pens for school."
    docs = [(1, clips.replace("Natalia", "Betty")), (2, "intro. " + clips.replace("48", "30").replace("24", "30")), (3, anna.replace("Anna", "Mary Ann")), (4, anna.replace("Anna", "McDonald")), (5, anna.replace("Anna", "O'Brien")), (6, anna.replace("Anna", "ANNA")), (7, clips.replace("Natalia", "Betty", 1)), (8, "Nothing of the kind is said in this text at all.")]
    items = spark.createDataFrame([(1, clips), (2, anna)], "item_id long, text string")
    for most in (decontaminate.MAX_LOOKUP, 1):
        monkeypatch.setattr(decontaminate, "MAX_LOOKUP", most)
        found = {(r.doc_id, r.item_id): (r.leak, r.changed) for r in decontaminate.leaks(spark.createDataFrame(docs, DOCS), items).collect()}
        assert {k for k, (leak, _) in found.items() if leak} >= {(1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (6, 2)}
        assert all(found[k][1] for k in [(1, 1), (2, 1), (3, 2)]) and not any(d == 8 for d, _ in found)


def test_aliases_against_recursive_sql(spark, sf):
    import duckdb

    from kavyamill.llm import queries

    sf = sf.replace("sf0.001", "sf0.01")
    wanted = duckdb.sql(queries.ORACLES["url_aliases"].replace("FROM pages", f"FROM '{sf}/pages.parquet'")).fetchall()
    found = list(map(tuple, queries.url_aliases(spark, sf).collect()))
    assert sorted(found, key=repr) == sorted(wanted, key=repr) and any(x[3] is None and x[4] == "block" for x in found)


def test_equal_keys_of_byte_and_class():
    """Contexts that differ only one byte before their anchors, of two kinds to the right, are told apart at every distance."""
    rng = random.Random(11)
    made = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    rights, left = [made(400) for _ in range(120)], made(199)
    parts = [left + bytes([97 + i % 26]) + rights[(i * 7 + i // 26) % 120] for i in range(400)]
    before = np.full(len(parts), 200)
    found = substring_dedup.recurring(np.zeros(len(parts), np.int64), before, parts)
    for d in (0, 1, 2, 77, 100, 199, 200):
        count = collections.Counter(x[200 - d : 600 - d] for x in parts)
        assert found[:, d].tolist() == [count[x[200 - d : 600 - d]] > 1 for x in parts], d


def test_similar_pairs_against_sets(monkeypatch):
    from kavyamill.llm import banding

    monkeypatch.setattr(banding, "COLUMNS", 7)
    monkeypatch.setattr(banding, "PIECE", 5)
    rng = random.Random(12)
    sets = [{rng.randrange(40) for _ in range(rng.randrange(0, 30))} for _ in range(30)]
    sets += [set(sets[3]), set(sets[4]) | {99}]
    h = np.array([x for s in sets for x in s], np.uint64)
    owner = np.array([i for i, s in enumerate(sets) for _ in s])
    rows = np.array([0, 3, 4, 5, 9, 31])
    found = {(int(i), int(j)) for left, right in banding.similar_pairs(h, owner, rows, len(sets), 0.5) for i, j in zip(left, right, strict=True)}
    assert found == {(i, j) for i in rows.tolist() for j in range(len(sets)) if sets[i] | sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.5}


def test_recall_of_reworded_parameters(spark):
    """Questions with other names, numbers, units and letter case, each inside other text."""
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdeilmnorst") for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    names = ["Alice", "Bob", "Natalia", "Mary Ann", "O'Brien", "McDonald"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items, docs = [], []
    for i in range(40):
        middle = [some(rng.randrange(5, 12)) for _ in range(4)]

        def made(name: str, n: int, unit: str, middle=middle) -> str:
            return f"{name} {middle[0]} {n} {unit} {middle[1]}. {middle[2]} {name} {middle[3]} {n} {unit}?"

        first = made(rng.choice(names[:3]), rng.randrange(2, 900), rng.choice(["km", "kg", "dollars"]))
        items.append((i, first))
        other = made(rng.choice(names), rng.randrange(2, 900), rng.choice(["mi", "lb", "euros"]))
        for j, text in enumerate((other, first.lower(), first.upper(), first)):
            docs.append((10 * i + j, f"{some(30)}. {text} {some(20)}"))
        docs.append((10 * i + 9, some(60)))
    rows = decontaminate.leaks(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, "item_id long, text string")).where("leak").collect()
    found = {r.doc_id for r in rows if r.doc_id // 10 == r.item_id}
    for j in range(4):
        assert sum(10 * i + j in found for i in range(40)) >= 38, j
    assert not any(r.doc_id % 10 == 9 for r in rows)
