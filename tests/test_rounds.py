"""Work in rounds against plain loops: circles, ties, nulls, repeated rows, nothing at all."""

import random

from pyspark.sql import functions as F

from kavyamill.operators import rounds as R


def test_crawl(spark):
    rng = random.Random(1)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(90)] + [(100 + i, 101 + i) for i in range(12)] + [(112, 100), (3, 100), (None, 4), (5, None), (3, 100)]
    seeds = [3, 50, 3, None]
    depth, frontier, k = {s: 0 for s in seeds if s is not None}, [3, 50], 0
    while frontier:
        k += 1
        frontier = list({b for a, b in links if a in frontier and b is not None and b not in depth})
        depth |= dict.fromkeys(frontier, k)
    frame = spark.createDataFrame(links, "source long, target long").withColumn("node", F.lit("odd")).withColumn("depth", F.lit(7))
    start = spark.createDataFrame([(s,) for s in seeds], "node long")
    rows = R.crawl(frame, start).collect()
    assert len(rows) == len(depth) and {r.node: r.depth for r in rows} == depth
    assert {r.node for r in R.crawl(frame, start, most_rounds=1).collect()} == {n for n, d in depth.items() if d <= 1}
    assert R.crawl(frame, start.where("false")).count() == 0 and R.crawl(frame.where("false"), start).count() == 2


def test_retried(spark):
    rows = [(i, i % 7) for i in range(60)] + [(1, 1)] * 3
    seen = []

    def attempt(df, k):
        seen.append(df.count())
        return df.withColumn("score", F.col("need") * 10 + k).withColumn("passed", F.when(F.col("need") < 6, F.col("need") <= k))

    out = R.retried(spark.createDataFrame(rows, "id int, need int").withColumn("other", F.lit("x")), attempt).collect()
    assert sorted((r.id, r.attempts, r.passed, r.score) for r in out) == sorted((i, min(n, 3) + 1, n <= 3, n * 10 + min(n, 3)) for i, n in rows)
    assert seen == [sum(n >= k for _, n in rows) for k in range(4)]
    seen.clear()
    assert R.retried(spark.createDataFrame([(1, 0)], "id int, need int"), attempt).count() == 1 and seen == [1]
    assert R.retried(spark.createDataFrame([], "id int, need int"), attempt).count() == 0


def test_running_total_and_files(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 0, 1, 5, 900])) for i in range(500)]
    found = {r.id: r.before for r in R.running_total(spark.createDataFrame(rows, "id int, n int").repartition(7), ["id"], F.col("n")).collect()}
    total, wanted = 0, {}
    for i, n in rows:
        wanted[i] = total
        total += n or 0
    assert found == wanted
    texts = [(i, "é" * rng.randrange(30)) for i in range(200)] + [(900, None)]
    R.write_rotated_by_bytes(spark.createDataFrame(texts, "id int, line string"), ["id"], "line", 500, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("file=*"), key=lambda p: int(p.name[5:]))
    parts = [list(p.glob("part-*")) for p in files]
    assert all(len(p) == 1 for p in parts)
    held = [p[0].read_text().split("\n")[:-1] for p in parts]
    assert [x for h in held for x in h] == [t for _, t in texts if t is not None]
    assert all(sum(len(x.encode()) + 1 for x in h) <= 500 + 61 for h in held)
    assert R.running_total(spark.createDataFrame([], "id int, n int"), ["id"], F.col("n")).count() == 0


def test_first_wins(spark):
    lists = [[3, 1, 2, 2], [2, 9, 4], [1, 5, 3]]
    frames = [spark.createDataFrame([(x, x * 10) for x in xs], "k int, at int") for xs in lists]
    out = R.first_wins(frames, "k", "at", 5).orderBy("place").collect()
    assert [(r.k, r["list"], r.place) for r in out] == [(1, 0, 0), (2, 0, 1), (3, 0, 2), (4, 1, 3), (9, 1, 4)]


def test_onsets(spark):
    rng = random.Random(5)
    clips = {c: [rng.choice([None, 0.0, 10.0, 30.0, 50.0, 70.0, 90.0]) for _ in range(n)] for c, n in (("a", 1), ("b", 200), ("c", 64), ("d", 16))} | {"e": [50.0] * 40 + [90.0, 90.0, 30.0], "f": [90.0, 90.0]}
    wanted = set()
    for c, raw in clips.items():
        r = [float("-inf") if x is None else x for x in raw]
        for i in range(len(r) - 1):
            if r[i] > 60 and not (i and r[i - 1] > 60) and r[i + 1] > 20:
                s = i
                while s and r[s - 1] > 20:
                    s -= 1
                wanted.add((c, i, s))
    frames = spark.createDataFrame([(c, i, x) for c, r in clips.items() for i, x in enumerate(r)], "clip string, at int, level double")
    for span in (1, 4, 16, 4096):
        assert {tuple(x) for x in R.onsets(frames, "clip", "at", "level", 60.0, 20.0, span).collect()} == wanted
    assert R.onsets(frames.where("false"), "clip", "at", "level", 60.0, 20.0).count() == 0


def test_nearest_of(spark):
    from kavyamill.operators import corpus as C

    rng = random.Random(8)
    refs = [(rng.randrange(4000), i) for i in range(60)] + [(7, 99), (7, 3), (None, 1)]
    values = sorted({rng.randrange(-50, 4500) for _ in range(300)} | {7, 8})
    wanted = {v: min((abs(v - r), i) for r, i in refs if r is not None) for v in values}
    held = spark.createDataFrame(refs, "n int, item int")
    asked = spark.createDataFrame([(v,) for v in [*values, None]], "n int")
    for span in (10, 500, 1 << 20):
        rows = C.nearest_of(asked, held, "n", "item", span).collect()
        assert len(rows) == len(values) and {r.n: (r.gap, r.item) for r in rows} == wanted
    assert C.nearest_of(asked, held.where("false"), "n", "item").count() == 0
