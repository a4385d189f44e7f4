import difflib
import math
import unicodedata

from pyspark.sql import functions as F

from kavyamill import dims
from kavyamill.functions import arrow as A
from kavyamill.functions import text as X
from kavyamill.functions import units as U
from kavyamill.operators import corpus as C
from kavyamill.operators import timeline as T
from kavyamill.operators import verse as V


def test_composition(spark):
    texts = ["rāma", "m̐", "kṝ", "", None, "é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", A.nfc("t").alias("n"), A.nfc_spans("t").alias("s")).collect():
        assert r.n == (None if r.t is None else unicodedata.normalize("NFC", r.t))
        if r.t is not None:
            assert "".join(x.ch for x in r.s) == r.n
            assert all(unicodedata.normalize("NFC", r.t[x.start : x.end]).find(x.ch) >= 0 for x in r.s)


def test_similarity_and_fades(spark):
    df = spark.createDataFrame([("abcd", "abxd", "z"), ("q", "abcdefgh", "z"), ("abc tat", "abc", "tat")], "a string, b string, c string")
    rows = df.select("a", "b", A.sequence_ratio("a", "b").alias("r"), A.tail_check(F.col("a"), F.col("b"), F.col("c")).alias("t")).collect()
    assert [r.t for r in rows] == ["ok", "truncated", "bleed"]
    assert all(math.isclose(r.r, difflib.SequenceMatcher(None, r.a, r.b).ratio()) for r in rows)
    out = spark.createDataFrame([([1.0] * 10,)], "s array<double>").select(A.faded(F.col("s"), 3, 3).alias("f")).first().f
    assert out[:3] == [0.0, 0.5, 1.0] and [round(x, 6) for x in out[-3:]] == [1.0, 0.5, 0.0]


def test_clusters(spark):
    df = spark.createDataFrame([("धर्मक्षेत्रे तत्",), ("अहं",)], "t string")
    assert [r.c for r in df.select(A.deva_clusters(F.col("t")).alias("c")).collect()] == [["ध", "र्म", "क्षे", "त्रे", "त", "त्"], ["अ", "हं"]]


def test_round_trip_of_scripts(spark):
    words = ["धर्मक्षेत्रे", "कुरुक्षेत्रे", "ऐश्वर्यम्", "संस्कृतम्", "दुःखम्", "ऋषिः", "औषधम्", "ज्ञानम्"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.w for r in df.select(X.iast_to_deva(X.deva_to_iast(F.col("w"))).alias("w")).collect()] == words


def test_feet():
    assert dims.expand_feet("m b n t t G G") == "GGGGLLLLLGGLGGLGG"
    assert len(dims.meter_rows()) == 128 and len(dims.vedic_rows()) == 61


def test_timeline_pieces(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0, 1.5, 9.0],)], "v array<double>")
    assert df.select(T.clamp_rising(F.col("v"), 0.5).alias("x")).first().x == [1.0, 2.0, 2.5, 3.0, 9.0]
    assert df.select(T.greedy_merge(F.col("v"), 3.0).alias("x")).first().x == [3.0, 3.5, 9.0]
    frames = spark.createDataFrame([("c", 0.1, 5.0), ("c", 0.3, 1.0), ("c", 0.5, 1.0), ("c", 0.9, 0.5)], "clip string, t double, level double")
    spans = spark.createDataFrame([("c", 0.0, 0.6)], "clip string, st double, et double")
    best = T.quietest(frames, spans, ["clip"], "t", "level", "st", "et", 0.5).first()
    assert (best["at"], best["db"]) == (0.3, 0.0)
    assert T.is_monotonic(frames, ["clip"], "t", "level").count() == 3
    assert df.select(T.rms(F.col("v"), 2, 2).alias("r")).first().r == [math.sqrt(2.5 + 1e-12), math.sqrt((4 + 2.25) / 2 + 1e-12)]


def test_gates_and_quota(spark):
    df = spark.createDataFrame([(2.0, 0.35, False), (7.0, 0.5, False), (7.0, 0.5, True), (2.0, 0.3, False)], "d double, s double, special boolean")
    assert [r.g for r in df.select(C.gold_gate(F.col("d"), F.col("s"), F.col("special")).alias("g")).collect()] == [True, False, True, False]
    assert [r.g for r in df.select(C.hemistich_gate(F.col("d"), F.col("s")).alias("g")).collect()] == [False, True, True, False]
    assert df.select(V.authority(F.lit("indravajra"), F.lit("classical")).alias("a")).first().a == "dual-root-bhasya"


def test_recitation_pieces(spark):
    rows = [(["a b", "c d"], ["x"] * 32, 8), (["a", "b", "c", "d"], ["x"] * 32, 8), (["all in one"], ["x"] * 32, 8), (["prose"], ["x"] * 9, None), (["p1", "p2", "p3", "p4"], ["y"] * 76, 19), (["short"], ["x"] * 5, 8), (["one"], ["z"] * 44, None)]
    df = spark.createDataFrame(rows, "w array<string>, s array<string>, n int")
    found = [r.p for r in df.select(V.recitation_pieces(F.col("w"), F.col("s"), F.col("n")).alias("p")).collect()]
    assert found == [["a b", "c d"], ["a b", "c d"], ["x" * 16] * 2, ["prose"], ["p1", "p2", "p3", "p4"], ["short"], ["z" * 22] * 2]


def test_half_verses(spark):
    from kavyamill.operators import meter as M

    line = "GGGGLLLLLGGLGGLGG"
    whole = spark.createDataFrame([("v", 0, line), ("v", 1, line)], "verse_id string, unit_no int, pattern string")
    doubled = whole.unionByName(whole.withColumn("unit_no", F.col("unit_no") + 2))
    both = V.hemistich_candidate(M.identify(whole.where("false"), "classical").unionByName(M.identify(whole.select("verse_id", "unit_no", F.lit("GG").alias("pattern")), "classical")), M.identify(doubled, "classical"))
    assert tuple(both.first()) == ("v", "provisional", "mandakranta", "exact", True)


def test_word_weights(spark):
    df = spark.createDataFrame([("sarvasya cāhaṁ hṛdi sanniviṣṭo",)], "l string")
    found = df.select(V.word_weights(F.col("l")).alias("w")).first().w
    assert [tuple(x) for x in found] == [("sarvasya", "GGL"), ("cāhaṁ", "GG"), ("hṛdi", "LL"), ("sanniviṣṭo", "GLGG")]
    urls = df.select(V.source_url(F.lit("the Book of Feet, 2"), {"Book": "u:1", "Feet": "u:2"}).alias("a"), V.source_url(F.lit("x"), {"Book": "u:1"}).alias("b")).first()
    assert tuple(urls) == ("u:1", None)


def test_unit_helpers(spark):
    from kavyamill.functions import units as U

    m = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))
    pair = lambda roman, deva: U.deva_clusters_match(F.array(*map(F.lit, roman)), F.lit(deva))
    r = spark.range(1).select(U.map_put(m, F.lit("a"), F.lit(9)).alias("put"), U.map_delete(m, F.lit("b")).alias("deleted"), pair(["dhar", "ma"], "धर्म").alias("same"), pair(["dhar"], "धर्म").alias("other"), U.first_known(F.lit(None).cast("string"), F.lit(""), F.lit("x")).alias("known"), U.spread(F.array(F.lit(1.0), F.lit(9.0)), F.array(F.lit(2), F.lit(0))).alias("parts"), U.duration_budget(F.lit(1.0), F.lit(3), F.lit(0.0)).alias("none")).first()
    assert r.put == {"a": 9, "b": 2} and r.deleted == {"a": 1} and r.known == "x" and r.parts == [1.0, 1.0] and r.none is None
    assert [tuple(x) for x in r.same] == [("dhar", "ध"), ("ma", "र्म")] and r.other is None


def test_sum_does_not_depend_on_the_order(spark):
    rows = [(1, x / 100) for x in range(7, 60_000, 7)] + [(2, 0.1)] * 10 + [(3, 1e300), (3, 1.5)] + [(4, float("inf")), (4, 1.0)] + [(5, None)] + [(6, 1e-15)] * 2 + [(7, None), (7, 0.25)]
    data = spark.createDataFrame(rows, "k int, x double")
    for n in (1, 3, 7):
        found = {r["k"]: r["s"] for r in data.repartition(n, "x").groupBy("k").agg(U.exact_sum(F.col("x")).alias("s")).collect()}
        assert found == {1: sum(range(7, 60_000, 7)) / 100, 2: 1.0, 3: 1e300, 4: float("inf"), 5: None, 6: 2e-15, 7: 0.25}


def test_durations_add_values_in_the_order_of_rows(spark, tmp_path):
    """Bit for bit what one addition after the other gives, however the rows are split into files, row groups and tasks."""
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    from kavyamill.plans import units

    rng = random.Random(5)
    rows = [(rng.choice([1, 2, 3, 3, 3, None]), rng.choice([None, rng.randint(0, 60_000) / 100, rng.random(), 1e16, -1e16])) for _ in range(6_000)] + [(7, None), (8, float("nan")), (8, 1.0), (9, -0.5)]
    totals, counts = {}, {}
    for user, x in rows:
        counts[user] = counts.get(user, 0) + 1
        totals[user] = totals.get(user) if x is None else (totals.get(user) or 0.0) + x
    (tmp_path / "events.parquet").mkdir()
    for k, part in enumerate((rows[:2_500], rows[2_500:])):
        pq.write_table(pa.table({"user_id": pa.array([r[0] for r in part], pa.int64()), "value": pa.array([r[1] for r in part], pa.float64())}), tmp_path / "events.parquet" / f"part-{k}.parquet", row_group_size=300)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        found = {r.user_id: list(map(repr, r.spread)) for r in units.unit_durations(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    share = lambda x: x / 2 if x is not None and not x <= 2.0 else 1.0
    assert found == {u: [repr(share(totals[u]))] * 2 + [repr(float(n))] for u, n in counts.items()}


def test_script_searches_a_text_once(spark):
    texts = ["", None, "plain", "ab ক क", "x\n" * 9 + "ஃ", "rāma 𑌅 ಕ", "é", "क" * 3 + "a" * 7, "क" * 4 + "a" * 6, "12 |"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(X.script_of(F.col("t")).alias("a"), X.script_by_share(F.col("t")).alias("b"), X.script_strict(F.col("t")).alias("c"))
    plain = ("devanagari", "unknown", "iast")
    assert [tuple(r) for r in df.collect()] == [("devanagari", "unknown", "none"), ("devanagari", "unknown", "none"), plain, ("bengali", "unknown", "mixed"), ("tamil", "unknown", "iast"), ("grantha", "iast", "iast"), plain, ("devanagari", "unknown", "mixed"), ("devanagari", "devanagari", "mixed"), ("devanagari", "unknown", "none")]
    assert df.select("a")._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1


def test_weights_by_classes(spark):
    """The second scanner has no fold over letters, and finds by its own rules what the first one does."""
    import random

    from kavyamill.functions import prosody as P

    rng = random.Random(3)
    texts = ["", None, "krt", "a", "ak", "akt", "aM", "akM", "A", "MHa", "kaH~", "x" * 3] + ["".join(rng.choice("aiuAeOkKtnMH~é") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.pattern(F.col("t")).alias("a"), P.class_pattern(F.col("t")).alias("b"))
    rows = df.collect()
    assert [r.b for r in rows[:12]] == ["", None, "", "L", "L", "G", "G", "G", "G", "L", "G", "LLL"]
    assert all(r.a == r.b for r in rows if r.t is not None)
