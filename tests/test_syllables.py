"""Syllables with their places against a plain loop over the source; the second reading on odd verses."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from kavyamill.operators import syllables as S

VERSES = {
    "two-lines": "sarvasya cāhaṁ hṛdi sanniviṣṭo\r\nmattaḥ smṛtir jñānam apohanaṁ ca",
    "deva": "धर्मक्षेत्रे कुरुक्षेत्रे । समवेता युयुत्सवः ॥ १ ॥",
    "joined": "mā pha‍le-ṣu, “ka”dācana",
    "combining": "mā phaleṣu hṛdi ṝ",
    "pluta": "agnā3 i | agnā३ṃ",
    "hiatus": "a i ai i taiḥ k ha",
    "coda": "tat || vāk",
}
WANTED = {
    "two-lines": "GGLGGLLGLGG GGLGGLLGLGL",
    "deva": "GGGGLGGG LLGGLGLG",
    "joined": "GLGLLGLL",
    "combining": "GLGLLLG",
    "pluta": "GGL GG",
    "hiatus": "LLGLGL",
    "coda": "G G",
}
BAD = {"digit": ("janmādy 2 yat", ["unknown-character"]), "foreign": ("wife", ["unknown-character"]), "mark-first": ("ḥ ka", ["misplaced-mark"]), "two-marks": ("kaḥṃ", ["misplaced-mark"]), "pluta-apart": ("kat3", ["misplaced-mark"]), "consonants": ("k t", ["no-vowel"])}
SILENT = ["verse of nulls", None, "", "  ", "\n\r\n|", "॥ १ ॥"]


@pytest.fixture(scope="module")
def analysis(spark):
    return S.analyses(spark.createDataFrame(list(VERSES.items()), "verse_id string, text string")).cache()


def test_patterns_and_places(analysis):
    rows = sorted(analysis.collect(), key=lambda r: (r.verse_id, r.pada_index))
    for name, text in VERSES.items():
        padas = [r for r in rows if r.verse_id == name]
        assert " ".join(r.pattern for r in padas) == WANTED[name] and all(r.unread is None for r in padas)
        every = [x for r in padas for x in r.syllables]
        assert [x["index"] for x in every] == list(range(len(every)))
        ends = [0] + [x.end for x in every]
        for x, before in zip(every, ends, strict=False):
            assert x.source == text[x.start : x.end] and x.start >= before
            assert not text[before : x.start].strip(" \r\n,“”-।॥|‍")  # nothing with a sound lies between
            lines = text[: x.start].replace("\r\n", "\n").split("\n")
            assert (x.line, x.column) == (len(lines), len(lines[-1]) + 1)


def test_a_right_analysis_has_no_fault(analysis):
    assert S.recheck(analysis).collect() == []


def test_random_verses_agree(spark):
    rng = random.Random(6)
    sounds = ["k", "kh", "g", "ṅ", "c", "ch", "ñ", "ṭ", "ṭh", "ṇ", "t", "th", "d", "dh", "n", "p", "bh", "m", "y", "r", "l", "v", "ś", "ṣ", "s", "h"]
    vowels = ["a", "ā", "i", "ī", "u", "ū", "ṛ", "ṝ", "ḷ", "e", "ai", "o", "au"]

    def syllable():
        return "".join(rng.choice(sounds) for _ in range(rng.choice([0, 1, 1, 2, 3]))) + rng.choice(vowels) + rng.choice(["", "", "", "ṃ", "ḥ", "3"]) + rng.choice(["", "", " ", "-", "‌", "’"])

    verses = [(i, rng.choice(["\n", " | ", "\r\n"]).join("".join(syllable() for _ in range(rng.randrange(1, 20))) + rng.choice(["", "t", "n"]) for _ in range(rng.randrange(1, 5)))) for i in range(150)]
    found = S.analyses(spark.createDataFrame(verses, "verse_id int, text string"))
    assert found.where("unread is not null").count() == 0 and S.recheck(found).collect() == []


def test_verdicts(spark):
    rows = list(VERSES.items()) + [(k, t) for k, (t, _) in BAD.items()] + [(f"silent-{i}", t) for i, t in enumerate(SILENT)] + [("ascii", "raama"), ("mixed", "राम rāma")]
    out = {r.verse_id: r for r in S.verified(spark.createDataFrame(rows, "verse_id string, text string").selectExpr("*", "'odd' status", "1 padas")).collect()}
    assert len(out) == len(rows) and all(out[k].ok and out[k].status == "verified" for k in VERSES)
    assert all(out[k].errors == wanted and not out[k].ok for k, (_, wanted) in BAD.items())
    assert all(out[f"silent-{i}"].status == "not-run" for i in range(1, len(SILENT))) and out["ascii"].errors == ["ascii-scheme"] and "mixed-script" in out["mixed"].errors
    assert S.verified(spark.createDataFrame([], "verse_id string, text string")).count() == 0


def test_long_runs_of_letters(spark):
    text = "k" * 20000 + "a" + "ta" * 3000
    rows = S.analyses(spark.createDataFrame([(1, text), (2, "k" * 30000)], "verse_id int, text string")).select("verse_id", "pattern", "unread").collect()
    assert sorted(map(tuple, rows)) == [(1, "L" * 3001, None), (2, "", "no-vowel")]


def test_syllables_are_judged_in_their_row(spark):
    """No syllable is shuffled: verses are read without an exchange, and only counts and faults are gathered by verse."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    verses = spark.createDataFrame(list(VERSES.items()), "verse_id string, text string")
    made = S.analyses(verses)
    assert "Exchange" not in plan(made)
    assert plan(S.recheck(made)).count("Exchange") == 1


def test_a_long_line_is_read_in_linear_time(spark):
    """A line of 80,000 syllables: places are found in blocks, not from the line's beginning."""
    text = "rāma kṛṣṇa " * 20_000
    (row,) = S.verified(spark.createDataFrame([("long", text)], "verse_id string, text string")).collect()
    assert (row.status, row.syllables, row.guru) == ("verified", 80_000, 40_000)


def test_foreign_letters_are_unread_whatever_else_is_there(spark):
    """Each letter of FOREIGN, alone, with marks, after others, beside another script: the reading of every unit finds the same."""
    import re

    letters = [c for c in map(chr, range(0x250)) if re.match(f"[{S.FOREIGN}]", c)]
    assert set("fqwxzFQWXZ0124é") < set(letters) and not set("abcñÑ3~ṭ") & set(letters)
    verses = [(f"{c!r} {i}", t) for c in letters for i, t in enumerate((f"a{c}ta", f"{c}̣̄a", f"rāma-{c}", f"kRāma{c}3ḥ", f"धर्म a{c}"))]
    rows = S.analyses(spark.createDataFrame(verses, "verse_id string, text string")).select("verse_id", "unread", F.size("syllables").alias("n")).collect()
    assert len(rows) == len(verses) and all((r.unread, r.n) == ("unknown-character", 0) for r in rows)


def test_foreign_padas_are_not_read_further(spark):
    verses = [("one", "the wolf"), ("some", "rāma | wolf | sītā"), ("lines", "rāma\r\nquiz 3"), ("digit", "rāma 2"), ("number", "rāma || 2 ||"), ("deva", "धर्म २ 2"), ("mixed", "धर्म wolf"), ("only", "12"), ("null", None), ("twice", "fox"), ("twice", "rāma"), ("twice", "fox")]
    data = spark.createDataFrame(verses, "verse_id string, text string")
    full, brief = ({(r.verse_id, r.pada_index, r.source): (r.unread, r.pattern, r.matras, len(r.syllables)) for r in S.analyses(data, *how).collect()} for how in ((), (False,)))
    assert full == brief and len(brief) == 12
    assert {r.normalized for r in S.analyses(data, False).where("source like '%wolf' or source = 'fox'").collect()} == {"?"}
    out = {}
    for r in S.verified(data).collect():
        out.setdefault(r.verse_id, []).append((r.padas, r.syllables, r.guru, r.matras, " ".join(r.errors), r.status))
    assert {k: v for k, v in out.items() if k != "twice"} == {"one": [(1, 0, 0, 0, "unknown-character", "not-run")], "some": [(3, 4, 3, 7, "unknown-character", "not-run")], "lines": [(2, 2, 1, 3, "unknown-character", "not-run")], "digit": [(1, 0, 0, 0, "unknown-character", "not-run")], "number": [(1, 2, 1, 3, "", "verified")], "deva": [(1, 0, 0, 0, "unknown-character", "not-run")], "mixed": [(1, 0, 0, 0, "mixed-script unknown-character", "not-run")], "only": [(0, 0, 0, 0, "no-letters", "not-run")], "null": [(0, 0, 0, 0, "no-letters", "not-run")]}
    assert out["twice"] == [(3, 2, 1, 3, "unknown-character", "not-run")] * 3


def test_a_verse_with_an_error_is_not_read_twice(spark, monkeypatch):
    seen, judged = [], S._judged
    monkeypatch.setattr(S, "_judged", lambda analysis: seen.append({r.verse_id for r in analysis.select("verse_id").collect()}) or judged(analysis))
    verses = [("good", "rāma | sītā"), ("deva", "धर्म"), ("unread", "rāma ka:"), ("ascii", "raama"), ("mixed", "राम rāma"), ("foreign", "rāma | wolf"), ("number", "rāma || 2 ||"), ("null", None)]
    out = {r.verse_id: (r.syllables, r.matras, r.status) for r in S.verified(spark.createDataFrame(verses, "verse_id string, text string")).collect()}
    assert seen == [{"good", "deva", "unread", "number"}]
    assert out == {"good": (4, 7, "verified"), "deva": (2, 3, "verified"), "unread": (0, 0, "not-run"), "ascii": (3, 3, "not-run"), "mixed": (0, 0, "not-run"), "foreign": (2, 3, "not-run"), "number": (2, 3, "verified"), "null": (0, 0, "not-run")}
