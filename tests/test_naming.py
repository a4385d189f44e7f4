"""Names by ordered keys, against plain loops."""

import random

from kavyamill.operators import naming as N


def resolved(name, syllables):
    """The rules one after another, as a reader would apply them."""
    plain = (name or "").lower().strip()
    if plain.startswith(N.MIXED):
        return "vaṃśastha" if syllables == 12 or any(x in plain for x in N.MIXED_OF_TWELVE) else "upajāti", False, "mixed"
    for pairs, stands_in, tier in ((N.RECORDED, False, "name"), (N.SURROGATES, True, "surrogate")):
        if plain in dict(pairs):
            return dict(pairs)[plain], stands_in, tier
    for pairs, stands_in, tier in ((N.RECORDED, False, "within"), (N.SURROGATES, True, "surrogate-within")):
        for key, value in pairs:
            if key in plain:
                return value, stands_in, tier
    for n, value, stands_in in N.BY_COUNT:
        if n == syllables:
            return value, stands_in, "count"
    return N.BY_DEFAULT, True, "default"


NAMES = ["mandākrāntā", "śikhariṇī", "Toṭaka", " Mālinī ", "pañcacāmara", "upendravajrā x", "x indravajrā śloka", "the hariṇī and the mālinī", "hariṇī narkuṭaka", "narkuṭaka hariṇī", "upajāti (vaṃśastha–indravaṃśā)", "Upajāti", "upajati x", "no upajāti", "", "  ", None, "vasantatilaka", "vasantatilakāx", "sragdharāsragdhara", "a" * 5000 + "rucirā"]


def test_recordings(spark):
    rng = random.Random(2)
    keys = [k for k, _ in (*N.RECORDED, *N.SURROGATES)]
    names = NAMES + [rng.choice(keys) + rng.choice(["", " ", "x"]) + rng.choice(keys)[rng.randrange(3) :] for _ in range(300)]
    rows = [(i, name, rng.choice([None, 7, 8, 11, 12, 14, 15, 17, 19, 21])) for i, name in enumerate(names)] + [(0, "mandākrāntā", 17)] * 3
    out = N.recordings(spark.createDataFrame(rows, "id int, name string, n int").selectExpr("*", "'odd' tier", "1 rank", "'k' key", "'p' _plain"), "name", "n")
    assert out.columns == ["id", "name", "n", "rank", "key", "_plain", "bank_key", "is_surrogate", "tier"]
    found = sorted((r.id, r.name, r.n, r.bank_key, r.is_surrogate, r.tier) for r in out.where("name is not null").collect())
    assert found == sorted((*r, *resolved(r[1], r[2])) for r in rows if r[1] is not None)
    null = out.where("name is null").first()
    assert (null.bank_key, null.is_surrogate, null.tier) == resolved(None, null.n)
    assert N.recordings(spark.createDataFrame([], "name string, n int"), "name", "n").count() == 0


def test_first_contained(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda most: "".join(rng.choice("ab𝔸é") for _ in range(rng.randrange(most)))
    names = [word(14) for _ in range(400)] + ["", None, "a\nb" * 3, "ab" * 20000]
    keys = [(word(7), rng.randrange(20)) for _ in range(60)] + [("", 0), (None, 1), ("a\nb", 25)]
    wanted = {}
    for name in {x for x in names if x is not None}:
        hits = sorted((rank, key) for key, rank in keys if key and key in name)
        if hits:
            wanted[name] = hits[0]
    for most in (1 << 20, 0):  # anchors broadcast, and joined
        monkeypatch.setattr(N, "SENT", most)
        rows = N.first_contained(spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame(keys, "key string, rank int")).collect()
        assert {r.name: (r["rank"], r.key) for r in rows} == wanted and len(rows) == len(wanted)
    assert N.first_contained(spark.createDataFrame([("a",)], "name string"), spark.createDataFrame([], "key string, rank int")).count() == 0
