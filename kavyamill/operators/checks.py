"""A second opinion on meter reports: rules written anew as regular expressions, shapes and places, never the maker's.

Each issue is a row (verse_id, code, id); a report without a row stands. The tables of meters are broadcast, and a report is
checked in its row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kavyamill import dims
from kavyamill.functions import prosody as P

# The weights of the parts that the counted families are made of.
FOOT, ODD_FOOT, SIXTH = "(?:GG|GLL|LGL|LLG|LLLL)", "(?:GG|GLL|LLG|LLLL)", "(?:LGL|LLLL)"
HALVES = {
    "first": ODD_FOOT + FOOT + ODD_FOOT + FOOT + ODD_FOOT + SIXTH + ODD_FOOT + "G",
    "second": ODD_FOOT + FOOT + ODD_FOOT + FOOT + ODD_FOOT + "L" + ODD_FOOT + "G",
    "aryagiti": ODD_FOOT + FOOT + ODD_FOOT + FOOT + ODD_FOOT + SIXTH + ODD_FOOT + FOOT,
}
SLOKA = "(?:(?:(?!.LL)(?:....LGG.|.GLGGGG.|.GLGGLL.|.GGGGLL.|...GLLL.|...GGLG.))(?:(?!.LL)(?!.GLG)....LGL.))+"


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Shapes of the fixed meters and Vedic counts by the size of a verse, and meters of equal pādas by a line without its last."""
    shapes: dict[int, dict[tuple, list]] = {}
    stems: dict[str, list] = {}
    for r in dims.meter_rows():
        sizes = tuple(map(len, r[6]))
        # All finals are free: the two licensed one way end in a heavy syllable, for which a light one may stand.
        shapes.setdefault(sum(sizes), {}).setdefault(sizes, []).append(("".join(p[:-1] + "." for p in r[6]), r[1]))
        if r[3] == "sama-vrtta":
            stems.setdefault(r[5][0][:-1], []).append(r[1])
    counts: dict[int, list] = {}
    for base, ident, lengths, rank in dims.vedic_rows():
        counts.setdefault(sum(lengths), []).append((base, ident, rank, [sum(lengths[: i + 1]) for i in range(len(lengths))]))
    rows = [(n, [([sum(z[: i + 1]) for i in range(4)], list(z), x) for z, x in shapes.get(n, {}).items()], counts.get(n, [])) for n in {*shapes, *counts}]
    sized = spark.createDataFrame(rows, "n int, fixed array<struct<ends:array<int>,sizes:array<int>,of:array<struct<shape:string,id:string>>>>, counts array<struct<base:string,id:string,grade:int,ends:array<int>>>")
    return F.broadcast(sized), F.broadcast(spark.createDataFrame([*stems.items()], "stem string, alike array<string>"))


def _read(rows: DataFrame) -> DataFrame:
    """Rows with what is seen of a verse's lines, `given`, none of which may be null: units, verse, n, n_units, where they end."""
    rows = rows.withColumn("units", F.when(~F.exists("given", lambda x: x.isNull()), F.col("given"))).withColumn("verse", F.array_join("units", "")).withColumn("n", F.length("verse")).withColumn("n_units", F.size("units"))
    upto = lambda i: F.length(F.array_join(F.slice("units", F.lit(1), i), ""))
    rows = rows.withColumn("until", F.when(F.col("n_units") > 0, F.transform(F.sequence(F.lit(1), F.greatest("n_units", F.lit(1))), upto)))
    line = F.get("units", F.lit(0))
    return rows.withColumn("stem", F.when(F.col("n_units").between(1, 2), F.left(line, F.length(line) - 1)))


def expected_candidates() -> Column:
    """Structs (id, family) of all that fits a row of _read() with its _tables(): fixed, upajati, sloka, jati, vedic and partial."""
    one = lambda ident, family: F.struct(ident.alias("id"), F.lit(family).alias("family"))
    cut_at = lambda ends: F.size(F.array_except("until", ends)) == 0
    none = F.array().cast("array<struct<id:string,family:string>>")

    def fixed(s: Column) -> Column:
        bare = F.array_join(F.zip_with(s["ends"], s["sizes"], lambda end, size: F.concat(F.substr(F.col("verse"), end - size + 1, size - 1), F.lit("."))), "")
        return F.transform(P.bound(bare, lambda b: F.filter(s["of"], lambda x: x["shape"] == b)), lambda x: one(x["id"], "fixed"))

    found = [F.flatten(F.transform(F.filter("fixed", lambda s: cut_at(s["ends"])), fixed))]
    by_id = {r[1]: r[5][0] for r in dims.meter_rows()}
    for ident, _, a, b in dims.UPAJATI:
        size, first, second = len(by_id[a]), by_id[a][:-1], by_id[b][:-1]
        fits = (F.col("n") == 4 * size) & cut_at(F.array(*[F.lit(size * i) for i in range(1, 5)])) & F.col("verse").rlike(f"^(?:(?:{first}|{second}).){{4}}$") & ~F.col("verse").rlike(f"^(?:{first}.){{4}}$|^(?:{second}.){{4}}$")
        found.append(F.when(fits, F.array(one(F.lit(ident), "upajati"))))
    grades = lambda met: F.filter(met, lambda c: ~F.exists(met, lambda d: (d["base"] == c["base"]) & (d["grade"] < c["grade"])))
    found.append(F.transform(P.bound(F.filter("counts", lambda c: cut_at(c["ends"])), grades), lambda c: one(c["id"], "vedic")))
    eights = (F.col("n") >= 32) & (F.col("n") % 16 == 0) & F.forall("units", lambda u: F.length(u) % 8 == 0)
    found.append(F.when(eights, F.array(one(F.lit("anustubh-sloka"), "sloka"))))
    # Times of the lines' ends: a heavy syllable counts two.
    times = lambda x: F.length(x) + F.length(F.replace(x, F.lit("L"), F.lit("")))
    untils = F.transform("until", lambda e: times(F.substr("verse", F.lit(1), e)))
    for ident, _, quarters, halves in dims.JATI:
        ends = F.array(*[F.lit(sum(quarters[: i + 1])) for i in range(4)])
        fits = (times(F.col("verse")) == sum(quarters)) & F.col("verse").rlike(f"^{HALVES[halves[0]]}{HALVES[halves[1]]}$") & (F.size(F.array_except(untils, ends)) == 0)
        found.append(F.when(fits, F.array(one(F.lit(ident), "jati"))))
    same = F.forall("units", lambda u: (F.length(u) == F.length("stem") + 1) & u.startswith(F.col("stem")))
    found.append(F.when(same, F.transform("alike", lambda x: one(x, "partial"))))
    return F.concat(*[F.coalesce(x, none) for x in found])


def omitted() -> Column:
    """What fits and is not listed, for the tradition that each report says it was asked for, of a row with `due`, what fits."""
    of = lambda *families: F.exists("due", lambda x: x["family"].isin(*families))
    exact = of("fixed", "upajati", "jati") | (of("sloka") & F.col("verse").rlike(f"^{SLOKA}$"))
    rows_near = F.exists("candidates", lambda c: c["match_type"] == "near")
    wants_vedic = (F.col("requested") == "vedic") | ((F.col("requested") == "auto") & ~exact)
    whole = of("fixed", "upajati", "jati", "sloka") | rows_near | (of("vedic") & wants_vedic)
    state = F.struct(wants_vedic.alias("vedic"), ((F.col("requested") != "vedic") & ~whole).alias("partial"), (F.col("requested") != "vedic").alias("other"), F.transform("candidates", lambda c: c["id"]).alias("ids"))
    wanted = lambda s, x: F.when(x["family"] == "vedic", s["vedic"]).when(x["family"] == "partial", s["partial"]).otherwise(s["other"])
    left = P.bound(state, lambda s: F.filter("due", lambda x: wanted(s, x) & ~F.array_contains(s["ids"], x["id"])))
    return F.transform(left, lambda x: F.struct(F.lit("EXPECTED_CANDIDATE_OMITTED").alias("code"), x["id"].alias("id")))


def _order_key(c: Column) -> Column:
    """Text that sorts as candidates should: how they match, by what evidence, how far, in how many pieces, and the id."""
    match = F.coalesce(F.try_element_at(F.create_map(*map(F.lit, ("exact", "0", "class-compatible", "1", "partial", "2"))), c["match_type"]), F.lit("3"))
    evidence = F.coalesce(F.try_element_at(F.create_map(*map(F.lit, ("full-verse", "0", "extended-stanza", "1", "count-only", "2"))), c["evidence"]), F.lit("3"))
    return F.concat(match, evidence, F.lpad(c["distance"].cast("string"), 9, "0"), F.lpad(c["boundary_transformations"].cast("string"), 9, "0"), F.when(c["tradition"] == "vedic", "1").otherwise("0"))


def list_issues(rows: DataFrame) -> DataFrame:
    """Rows with `issues`, those of whole reports: the lines, repeated ids, order, first candidate, status and flag."""
    shown = lambda name: F.concat_ws(" ", F.transform(name, lambda p: F.coalesce(p, F.lit("?"))))
    rows = rows.withColumn("read", F.when(F.col("given").isNotNull(), shown("given")))
    rows = rows.withColumn("keys", F.transform("candidates", _order_key)).withColumn("ids", F.transform("candidates", lambda c: c["id"]))
    full_keys = F.transform(F.arrays_zip("keys", "ids"), lambda x: F.concat(x["keys"], x["ids"]))
    first = F.get("candidates", F.lit(0))
    rivals = F.size(F.filter("keys", lambda k: k == F.get("keys", F.lit(0))))
    sure = (first["match_type"] == "exact") & (first["evidence"] != "count-only") & (first["evidence"] != "fragment") & first["id"].isin(*dims.DUAL_AUTHORITY)
    readable = ~F.coalesce(F.contains("read", F.lit("?")), F.lit(True))
    due = F.when(~readable, "invalid-analysis").when((F.size("candidates") == 0) | (first["match_type"] == "near"), "unidentified").when(first["match_type"] == "partial", "insufficient-evidence").when(rivals >= 2, "ambiguous").when(sure, "identified").otherwise("provisional")
    codes = {
        "UNIT_PATTERNS_CHANGED": ~shown("unit_patterns").eqNullSafe(F.col("read")),
        "DUPLICATE_CANDIDATE_ID": F.size(F.array_distinct("ids")) != F.size("ids"),
        "CANDIDATES_OUT_OF_ORDER": F.concat_ws(" ", full_keys) != F.concat_ws(" ", F.array_sort(full_keys)),
        "PRIMARY_MISMATCH": ~first["id"].eqNullSafe(F.col("primary_id")),
        "STATUS_MISMATCH": F.col("status") != due,
        "IDENTIFIED_FLAG_MISMATCH": F.col("identified") != (due == "identified"),
    }
    return rows.withColumn("issues", _issues(codes, F.lit(None).cast("string")))


def _issues(codes: dict[str, Column], ident: Column) -> Column:
    return F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(code).alias("code"), ident.alias("id"))) for code, bad in codes.items()]))


def candidate_issues() -> Column:
    """Issues of a candidate `c` of a row of _described(): target, observed pādas, distance and match, evidence, display and notes."""
    is_fixed, c = F.col("target").isNotNull(), F.col("c")
    pieces = F.size(c["observed"])
    whole = pieces == 4
    wanted = F.slice("target", F.lit(1), pieces)
    # Places that differ, but for each pāda's last.
    stems = F.zip_with(wanted, c["observed"], lambda e, o: F.struct(F.left(e, F.length(e) - 1).alias("e"), F.left(o, F.length(o) - 1).alias("o")))
    wrong = F.aggregate(stems, F.lit(0), lambda a, s: a + F.size(F.filter(F.sequence(F.lit(1), F.length(s["e"])), lambda i: F.substr(s["e"], i, F.lit(1)) != F.substr(s["o"], i, F.lit(1)))))
    match = F.when(~whole, "partial").when(wrong == 0, "exact").otherwise("near")
    freed = F.array_compact(F.transform(F.arrays_zip(wanted.alias("e"), c["observed"].alias("o")), lambda x, i: F.when(F.right(x["e"], F.lit(1)) != F.right(x["o"], F.lit(1)), F.concat(F.lit("final-licence-"), (i + 1).cast("string")))))
    shown = F.array_join(F.array_distinct("target"), "")
    bare = F.translate(F.regexp_replace(c["template"], "[ /*‖]", ""), "—◡", "GL")
    cuts = F.transform(F.split(F.regexp_replace(F.regexp_replace(c["template"], " / .*$", ""), r"[ *]", ""), "‖"), F.length)
    bars = F.transform(F.sequence(F.lit(1), F.greatest(F.size(cuts) - 1, F.lit(1))), lambda i: F.aggregate(F.slice(cuts, 1, i), F.lit(0), lambda a, x: a + x))
    clean = F.col("verse").rlike(f"^{SLOKA}$")
    halves = {ident: f"^{HALVES[h[0]]}{HALVES[h[1]]}$" for ident, _, _, h in dims.JATI}
    jati_clean = reduce(lambda a, x: F.when(F.col("id") == x[0], F.col("verse").rlike(x[1])).otherwise(a), halves.items(), F.lit(False))
    known = is_fixed | F.col("by_stem").isNotNull() | F.col("id").isin("anustubh-sloka", *[x[0] for x in dims.JATI], *[x[1] for x in dims.vedic_rows()])
    named_members = F.transform(c["observed"], lambda o: F.try_element_at("by_stem", F.left(o, F.length(o) - 1)))
    evidence = F.when(F.col("id").startswith("vedic-"), "count-only").when(is_fixed & ~whole, "fragment").when((F.col("id") == "anustubh-sloka") & (F.length("verse") > 32), "extended-stanza").otherwise("full-verse")
    is_sloka = F.col("id") == "anustubh-sloka"
    codes = {
        "UNKNOWN_CANDIDATE": ~known,
        "OBSERVED_PATTERN_CHANGED": F.array_join(c["observed"], "") != F.col("verse"),
        "FIXED_TARGET_CHANGED": is_fixed & ~c["expected"].eqNullSafe(wanted),
        "NAME_CHANGED": is_fixed & (c["name"] != F.col("true_name")),
        "MATCH_TYPE_MISMATCH": F.when(is_fixed, c["match_type"] != match).when(is_sloka, c["match_type"] != F.when(clean, "exact").otherwise("class-compatible")).when(F.col("id").isin(*halves), (c["match_type"] == "exact") != jati_clean).when(F.col("by_stem").isNotNull(), c["match_type"] != "exact").otherwise(c["match_type"] != "class-compatible"),
        "DISTANCE_MISMATCH": F.when(is_fixed, c["distance"] != wrong).when(c["match_type"] == "exact", c["distance"] != 0),
        "BOUNDARIES_MISMATCH": is_fixed & whole & (c["boundary_transformations"] != F.greatest(4 - F.col("n_units"), F.lit(0))),
        "FIXED_EVIDENCE_MISMATCH": c["evidence"] != evidence,
        "FIXED_NOTES_CHANGED": is_fixed & ~c["notes"].eqNullSafe(freed),
        "FIXED_SUBTYPES_CHANGED": is_fixed & (F.size(c["subtypes"]) != 0),
        "UPAJATI_SUBTYPES_CHANGED": F.col("by_stem").isNotNull() & ~c["subtypes"].eqNullSafe(named_members),
        "YATI_CHANGED": is_fixed & ~c["yati"].eqNullSafe(F.col("true_yati")),
        "TEMPLATE_CHANGED": is_fixed & ((bare != shown) | (F.col("true_yati").isNotNull() & ~bars.eqNullSafe(F.col("true_yati"))) | F.col("c.template").isNull()),
        "CLASSIFICATION_CHANGED": is_fixed & (~c["classification"]["gana_formula"].eqNullSafe(F.col("formula")) | (c["classification"]["system"] != "varna-vrtta")),
        "AUTHORITY_CHANGED": (c["authority"] == "dual-root-bhasya") != F.col("id").isin(*dims.DUAL_AUTHORITY),
    }
    return _issues(codes, F.col("id"))


def _described(rows: DataFrame) -> DataFrame:
    """Rows of a candidate `c` with what is known of its id: name, target, caesuras and feet, or the members of a mixed meter."""
    spark = rows.sparkSession
    fixed = spark.createDataFrame([(r[1], r[2], r[6], r[8], " / ".join(" · ".join({"b": "bha", "G": "G", "L": "L"}.get(c, c + "a") for c in f) for f in r[4])) for r in dims.meter_rows()], "id string, true_name string, target array<string>, true_yati array<int>, formula string")
    members = spark.createDataFrame([(u[0], {p[:-1]: n for n, p in ((r[2], r[5][0]) for r in dims.meter_rows() if r[1] in u[2:])}) for u in dims.UPAJATI], "id string, by_stem map<string,string>")
    return rows.withColumn("id", F.col("c.id")).join(F.broadcast(fixed), "id", "left").join(F.broadcast(members), "id", "left")


def of_rows(rows: DataFrame) -> DataFrame:
    """check() of reports that hold the lines of their verse as an array, `given`: rows of verse_id, code and id.

    Nothing is shuffled: a report meets fixed tables by broadcast joins, and what is wrong with it is found in its row; only
    its candidates become rows, with the report as a whole, whose candidate is null, before them.
    """
    sized, stems = _tables(rows.sparkSession)
    made = _read(rows).join(sized, "n", "left").join(stems, "stem", "left").withColumn("due", expected_candidates())
    made = list_issues(made).withColumn("whole", F.concat("issues", omitted()))
    kind = rows.schema["candidates"].dataType
    parts = F.concat(F.array(F.lit(None).cast(kind.elementType)), F.when(F.col("verse").isNotNull(), F.col("candidates")).otherwise(F.array().cast(kind)))
    parts = made.select("verse_id", "verse", "n_units", "whole", F.posexplode_outer(parts).alias("place", "c"))
    found = F.when(F.col("place") == 0, F.col("whole")).otherwise(candidate_issues())
    return _described(parts).select("verse_id", F.explode_outer(found).alias("x")).where("x is not null").select("verse_id", "x.code", "x.id")


def check(units: DataFrame, reports: DataFrame) -> DataFrame:
    """(verse_id, code, id) of all that is wrong with reports on (verse_id, unit_no, pattern); no row where all is right.

    Verses with a null pattern have no candidates to look for: for them only the report as a whole is checked.
    """
    lines = units.groupBy("verse_id").agg(F.array_sort(F.collect_list(F.struct("unit_no", "pattern"))).alias("given"))
    return of_rows(reports.join(lines.withColumn("given", F.transform("given", lambda x: x["pattern"])), "verse_id", "left"))
