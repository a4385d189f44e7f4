"""The maker of meter reports and its checker agree on verses that neither was made for."""

import random

from kavyamill import dims
from kavyamill.operators import checks as K
from kavyamill.operators import meter as M
from kavyamill.operators import report as R
from kavyamill.plans.registry import meter as Q


def made(seed: int) -> list[tuple[str, int, str, str]]:
    """Verses of many kinds: whole, nearly right, joined lines, fragments, feet of the mātrā meters, counts, rubbish."""
    r = random.Random(seed)
    fixed = [m[6] for m in dims.meter_rows()]
    feet = {4: ["GG", "GLL", "LGL", "LLG", "LLLL"], 2: ["G", "LL"], 1: ["L"]}
    out = []
    for i in range(160):
        kind = i % 8
        lines = list(r.choice(fixed))
        if kind == 1:
            at = r.randrange(4)
            place = r.randrange(len(lines[at]))
            lines[at] = lines[at][:place] + "GL"[lines[at][place] == "G"] + lines[at][place + 1 :]
        elif kind == 2:
            lines = [lines[0] + lines[1], lines[2] + lines[3]]
        elif kind == 3:
            lines = lines[: r.randint(1, 3)]
        elif kind == 4:
            _, _, quarters, halves = r.choice(dims.JATI)
            whole = "".join(r.choice(feet[f]) for h in halves for f in dims.JATI_FEET[h])
            lines, size = [""], 0
            for c in whole:
                lines[-1] += c
                size += 1 + (c == "G")
                if size in [sum(quarters[: k + 1]) for k in range(3)] and r.random() < 0.7:
                    lines.append("")
        elif kind == 5:
            lengths = r.choice(dims.vedic_rows())[2]
            lines = ["".join(r.choice("LG") for _ in range(n)) for n in lengths]
        elif kind == 6:
            pair = r.choice([("GGLGGLLGLG", "LGLGGLLGLG"), ("LGLGGLLGLGL", "GGLGGLLGLGL")])
            lines = [r.choice(pair) + r.choice("LG") for _ in range(4)]
        elif kind == 7:
            odd = ["..GGLGG.", ".GLGGGG."]
            lines = ["".join(r.choice("LG") if c == "." else c for c in r.choice(odd)[:8].ljust(8, ".")) if k % 2 == 0 else "".join(r.choice("LG") for _ in range(4)) + "LGL" + r.choice("LG") for k in range(r.choice([4, 6]))]
        asked = r.choice(["auto", "classical", "vedic"])
        out += [(f"v{i}", k, x, asked) for k, x in enumerate(lines) if x]
    return out


def test_the_checker_agrees_with_true_reports(spark):
    units = spark.createDataFrame([*made(5), ("broken", 0, None, "auto"), ("broken", 1, "GG", "auto"), ("empty", 0, "", "auto")], "verse_id string, unit_no int, pattern string, asked string").cache()
    reports = R.report(units).cache()
    assert [tuple(x) for x in K.check(units, reports).collect()] == []
    found = {x.verse_id: x for x in reports.collect()}
    assert found["broken"].status == "invalid-analysis" and found["broken"].candidates == []
    assert found["empty"].status == "unidentified" and len(found) == 162
    assert len({x.status for x in found.values()}) == 6


def test_no_rows(spark):
    units = spark.createDataFrame([], "verse_id string, unit_no int, pattern string")
    assert R.report(units).count() == 0 and K.check(units, R.report(units)).count() == 0


def test_scan(spark):
    texts = spark.createDataFrame([("a", "\n".join(Q.VERSES["bg-15-15"])), ("b", "janmādy 2 yat"), ("c", None), ("d", "")], "verse_id string, text string")
    found = {x.verse_id: (x.ok, x.meter.status, x.meter.primary_id) for x in R.scan(texts).collect()}
    assert found == {"a": (True, "identified", "indravajra"), "b": (False, "invalid-analysis", None), "c": (False, "invalid-analysis", None), "d": (False, "invalid-analysis", None)}


def test_a_verse_is_judged_in_its_row(spark):
    """What is made of a verse's row is not shuffled, whatever is asked of it, so no task holds more for larger tables."""
    rows = spark.createDataFrame([(1, ["GGLGGLLGLGG"] * 4, "classical"), (2, ["GGLGGLLGLGG"], "auto"), (3, ["GL", None], "auto"), (4, None, "auto")], "verse_id int, units array<string>, asked string")
    reports = R.of_rows(rows.selectExpr("*", "units as given"))
    found = K.of_rows(reports.withColumn("identified", ~reports.identified))
    for frame in (M.verdicts(rows), reports, found):
        shuffles = [x for x in frame._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x and "BroadcastExchange" not in x]
        assert shuffles == []
    assert sorted((x.verse_id, x.code) for x in found.collect() if x.verse_id < 4) == [(k, "IDENTIFIED_FLAG_MISMATCH") for k in (1, 2, 3)]
    assert [(x.status, x.primary_id) for x in M.verdicts(rows).orderBy("verse_id").collect()] == [("identified", "indravajra"), ("insufficient-evidence", "indravajra"), ("unidentified", None), ("unidentified", None)]
