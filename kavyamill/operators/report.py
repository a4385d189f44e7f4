"""Full reports of meter verdicts: candidates with what they are shown by, classification, diagnostics, summaries."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kavyamill import dims
from kavyamill.functions import prosody as P
from kavyamill.operators import meter as M
from kavyamill.operators import verse as V

# How feet are spoken, and the system of each kind of meter.
FOOT_NAMES = {"y": "ya", "m": "ma", "t": "ta", "r": "ra", "j": "ja", "b": "bha", "n": "na", "s": "sa", "G": "G", "L": "L"}
SYSTEMS = {"vedic": "vedic-chandas", "jati": "matra-jati"}
#: What an error of the analysis leaves of a verdict.
INVALID = "invalid-analysis"

_NAMED = "map<string,struct<name:string,forms:array<string>,lengths:array<int>,matra_ends:array<int>,feet:array<string>,yati:array<int>,members:array<struct<name:string,stem:string>>>>"


def named() -> Column:
    """By each id that a candidate may have: its name, pādas, quarters, feet, caesuras and members. A fixed table of a few
    hundred entries, folded into the plan."""
    by_id = {r[1]: r for r in dims.meter_rows()}
    rows: dict[str, dict] = {r[1]: {"name": r[2], "forms": r[6], "lengths": [len(p) for p in r[6]], "feet": r[4], "yati": r[8]} for r in by_id.values()}
    for ident, name, *pair in dims.UPAJATI:
        rows[ident] = {"name": name, "lengths": [len(by_id[pair[0]][5][0])] * 4, "members": [{"name": by_id[x][2], "stem": by_id[x][5][0][:-1]} for x in pair]}
    for ident, name, quarters, _ in dims.JATI:
        rows[ident] = {"name": name, "matra_ends": [sum(quarters[: i + 1]) for i in range(4)]}
    names = {ident: name for ident, name, _ in dims.VEDIC}
    for base, ident, lengths, _ in dims.vedic_rows():
        variant = ident.removeprefix(base).strip("-").replace("-", " ")
        rows[ident] = {"name": f"{names[base]} {variant}".strip(), "lengths": lengths}
    rows["anustubh-sloka"] = {"name": "anuṣṭubh (śloka)"}
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), _NAMED)


def gana_formula(feet: Column) -> Column:
    """Feet as they are spoken: the feet of a pāda with dots between, pādas with strokes; null for null."""
    spoken = F.create_map(*[F.lit(x) for pair in FOOT_NAMES.items() for x in pair])
    letters = lambda p: F.filter(F.split(F.regexp_replace(p, r"[\s_·-]", ""), ""), lambda c: c != "")
    return F.array_join(F.transform(feet, lambda p: F.array_join(F.transform(letters(p), lambda c: F.coalesce(F.try_element_at(spoken, c), c)), " · ")), " / ")


def classification(ident: Column, kind: Column, tradition: Column, lengths: Column, name: Column, formula: Column, yati: Column) -> Column:
    """(system, count_class, syllables_per_pada, symmetry, gana_formula, yati_note, cautions).

    Vedic candidates have their own name as count class and a caution that counts prove little; mātrā meters only a
    system; the others the count class of the pādas' common length, the symmetry, the feet and what is known of caesuras.
    """
    is_vedic, is_matra = tradition == "vedic", kind == "jati"
    common = F.when(F.size(F.array_distinct(lengths)) == 1, F.element_at(lengths, 1))
    counted = F.get(F.array(*map(F.lit, dims.COUNT_CLASSES)), common - 1)
    count_class = F.when(is_vedic, F.when(common.isNotNull(), name)).when(~is_matra, counted)
    symmetry = F.when(kind == "sama-vrtta", "one rule for all pādas").when(kind == "ardhasama-vrtta", "odd and even pādas pair").when(kind == "visama-vrtta", "each pāda has its rule").when(kind == "dandaka", "long pādas of one foot").when(kind == "upajati", "siblings mix by pāda").when(kind == "sloka", "cadences by pāda")
    note = F.when(ident == "indravajra", "no caesura inside a pāda").when(F.size(yati) > 0, F.concat(F.lit("caesura after syllable "), F.array_join(yati.cast("array<string>"), " and ")))
    varna = ~is_vedic & ~is_matra
    cautions = F.array_compact(F.array(F.when(is_vedic, "counts alone do not identify a Vedic meter"), F.when(varna & (common == 11), "the count class is not the Vedic meter of that name")))
    return F.struct(
        F.coalesce(F.when(is_vedic, SYSTEMS["vedic"]), F.when(is_matra, SYSTEMS["jati"]), F.lit("varna-vrtta")).alias("system"),
        count_class.alias("count_class"),
        F.when(count_class.isNotNull(), common).alias("syllables_per_pada"),
        F.when(varna, symmetry).alias("symmetry"),
        F.when(varna, formula).alias("gana_formula"),
        F.when(varna, note).alias("yati_note"),
        cautions.alias("cautions"),
    )


def diagnostic(status: Column, match_type: Column, tradition: Column, covered: Column, tied: Column) -> Column:
    """Why a verdict is no more than it is; null for an identified meter. covered: both lanes of authority are on record."""
    provisional = F.when(tradition == "vedic", "Only the syllable counts of a Vedic class agree; accent and cadence were not looked at.").when(~covered, "The pattern agrees, but root and commentary are not both on record for this meter.").otherwise("The text agrees in part; its evidence is too thin to identify the meter.")
    out = F.when(status == INVALID, "The text could not be scanned, so no meter was looked for.").when(match_type.isNull(), "Neither a pattern of the catalog nor a count class agrees.")
    out = out.when(status == "ambiguous", F.concat(tied.cast("string"), F.lit(" candidates are equally good; none was preferred.")))
    out = out.when(status == "insufficient-evidence", "A pāda agrees, but the stanza is not complete.").when(status == "provisional", provisional)
    return out.when(match_type == "near", "Nothing agrees exactly; the nearest meters of this length are listed.")


def report(units: DataFrame, tradition: str = "auto", include_near: bool = True) -> DataFrame:
    """A row for each verse of (verse_id, unit_no, pattern): requested, status, identified, primary_id, unit_patterns,
    diagnostics and all candidates in their order, each with name, observed and expected pādas, template, caesuras,
    subtypes, notes and classification.

    A null pattern is a line that could not be scanned: its verse is an invalid analysis without candidates. A column
    `asked` of the units overrides `tradition` by verse. Nothing is collected beyond one verse's candidates.
    """
    return of_rows(M.verses(units, tradition), include_near)


def of_rows(rows: DataFrame, include_near: bool = True) -> DataFrame:
    """Rows of (units, asked), a verse each, without these but with what report() says of it; nothing is shuffled."""
    made = M.listed(rows, include_near)
    others = [x for x in rows.columns if x not in ("units", "asked")]
    words = lambda c: {"tied": M.tied(c).cast("long"), **M.named_fields(c)}
    made = made.withColumn("c", F.transform("found", lambda c, i: F.struct((i + 1).alias("rank"), *[x.alias(name) for name, x in words(c).items()], F.element_at(named(), c["id"]).alias("named"))))
    eights = F.transform(F.sequence(F.lit(1), F.greatest((F.col("n") / 8).cast("int"), F.lit(1))), lambda i: i * 8)
    before = lambda m: F.length(F.translate(F.substr("moras", F.lit(1), m), M.LATER, ""))

    def ends(c: Column) -> Column:
        return F.when(c["match_type"] == "partial", F.col("cum")).when(c["kind"] == "sloka", eights).when(c["kind"] == "jati", F.transform(c["named"]["matra_ends"], before)).otherwise(P.prefix_sums(c["named"]["lengths"]))

    def observed(c: Column) -> Column:
        return F.transform(c["ends"], lambda e, i: P.bound(F.when(i > 0, F.get(c["ends"], i - 1)).otherwise(0), lambda begin: F.substr(F.col("pattern"), begin + 1, e - begin)))

    expected = lambda c: F.when(c["named"]["forms"].isNotNull(), F.slice(c["named"]["forms"], F.lit(1), F.size(c["observed"])))
    steps = {"ends": ends, "observed": observed, "expected": expected}
    adding = lambda name, step: lambda c: c.withField(name, step(c))
    for name, step in steps.items():  # a column for each, so that what is used twice is worked out once
        made = made.withColumn("c", F.transform("c", adding(name, step)))
    none = F.array().cast("array<string>")

    def shown(c: Column) -> Column:
        held, seen = c["named"], c["observed"]
        licence = F.array_compact(F.transform(seen, lambda p, i: F.when(F.right(p, F.lit(1)) != F.right(F.get(c["expected"], i), F.lit(1)), F.concat(F.lit("final-licence-"), i + 1))))
        member = lambda p: F.get(F.transform(F.filter(held["members"], lambda m: p.startswith(m["stem"])), lambda m: m["name"]), F.lit(0))
        subtypes = F.when(c["kind"] == "upajati", F.transform(seen, member)).when(c["kind"] == "sloka", F.transform(seen, lambda p, i: M.sloka_pada(p, i % 2 == 1)["subtype"])).otherwise(none)
        template = F.array_join(F.transform(F.array_distinct(held["forms"]), lambda p: P.template(p, held["yati"])), " / ")
        kept = ("rank", "id", "name", "kind", "tradition", "match_type", "distance", "boundary_transformations", "evidence", "tied", "observed", "expected")
        return F.struct(
            *[(held if x == "name" else c)[x].alias(x) for x in kept], template.alias("template"), held["yati"].alias("yati"),
            subtypes.alias("subtypes"), F.coalesce(licence, none).alias("notes"), V.authority(c["id"], c["tradition"]).alias("authority"),
            classification(c["id"], c["kind"], c["tradition"], F.transform(seen, F.length), held["name"], gana_formula(held["feet"]), held["yati"]).alias("classification"),
        )

    made = made.select(*others, "asked", "unit_patterns", F.explode_outer(F.array(F.transform("c", shown))).alias("candidates"))  # as in listed()
    first, broken = F.get("candidates", F.lit(0)), F.exists("unit_patterns", lambda u: u.isNull())
    full = (first["match_type"] == "exact") & first["evidence"].isin("full-verse", "extended-stanza")
    covered = first["authority"] == "dual-root-bhasya"
    status = F.when(broken, INVALID).when(first.isNull() | (first["match_type"] == "near"), "unidentified").when(first["match_type"] == "partial", "insufficient-evidence").when(first["tied"] > 1, "ambiguous").when(full & covered, "identified").otherwise("provisional")
    made = made.withColumn("status", status).withColumn("identified", F.col("status") == "identified").withColumn("primary_id", first["id"])
    diagnostics = F.array_compact(F.array(diagnostic(F.col("status"), first["match_type"], first["tradition"], covered, first["tied"])))
    return made.select(*others, F.col("asked").alias("requested"), "status", "identified", "primary_id", "unit_patterns", diagnostics.alias("diagnostics"), "candidates")


#: Columns of a report beside its verse's own.
REPORT = ("requested", "status", "identified", "primary_id", "unit_patterns", "diagnostics", "candidates")


def summary(reports: DataFrame) -> DataFrame:
    """The verdict of each report and a little evidence: label, first candidate's names, classification and display."""
    first = F.get("candidates", F.lit(0))
    c = first["classification"]
    label = V.verdict_label(first["name"], c["count_class"], c["syllables_per_pada"], F.when(F.col("status") != "unidentified", F.col("status")))
    return reports.select(
        *[x for x in reports.columns if x not in REPORT], (F.col("status") != INVALID).alias("ok"), F.when(first.isNotNull() & ~F.col("status").isin("unidentified", INVALID), label).otherwise("unidentified metre").alias("label"), "status", "identified",
        *[first[x].alias(x) for x in ("name", "kind", "tradition", "match_type", "template", "yati", "subtypes", "authority")], c["count_class"].alias("count_class"), c["gana_formula"].alias("gana_formula"), "diagnostics",
    )


def scan(verses: DataFrame, tradition: str = "auto") -> DataFrame:
    """Analysis and verdict of (verse_id, text) in one: the columns of verse.analyze, and the report as a struct.

    A text that could not be scanned has the status invalid-analysis; its diagnostics stand in the analysis.
    """
    analysis = V.analyze(verses)
    padas = analysis.select("verse_id", "ok", F.posexplode_outer("padas").alias("unit_no", "p"))
    units = padas.select("verse_id", F.coalesce("unit_no", F.lit(0)).alias("unit_no"), F.when(F.col("ok"), F.col("p.pattern")).alias("pattern"))
    reports = report(units, tradition)
    return analysis.join(reports.select("verse_id", F.struct(*[x for x in reports.columns if x != "verse_id"]).alias("meter")), "verse_id", "left")
