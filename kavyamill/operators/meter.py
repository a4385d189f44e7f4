"""Meter identification: verses' weight patterns against the meter table, ranked, with a status by evidence.

Verses come as units (written lines) of L/G patterns. Splitting units into pādas is a set question: the units'
running lengths must be among the pādas' running lengths, and the totals must agree. The meter tables are tiny and
fixed, so each join broadcasts them; verses are only shuffled by their own id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kavyamill import dims
from kavyamill.functions.prosody import bound, prefix_sums


def verses(units: DataFrame, tradition: str = "auto") -> DataFrame:
    """One row a verse of (verse_id, unit_no, pattern): verse_id, asked and its units in order."""
    wanted = F.first("asked") if "asked" in units.columns else F.lit(tradition)
    rows = units.groupBy("verse_id").agg(F.array_sort(F.collect_list(F.struct("unit_no", "pattern"))).alias("u"), wanted.alias("asked"))
    return rows.select("verse_id", "asked", F.transform("u", lambda x: x["pattern"]).alias("units"))


def _licensed(expected: Column, observed: Column, policy: Column) -> Column:
    return (policy == "bidirectional") | ((policy == "short-to-guru") & (expected == "G") & (observed == "L"))


# What candidates' numbers stand for, weights held by a number, and the second half of a heavy syllable.
MATCHES, EVIDENCE = ("exact", "class-compatible", "partial", "near"), ("full-verse", "extended-stanza", "count-only", "fragment")
WORD = 60
LATER = "\ue000"
_CANDIDATE = "array<struct<match:int,evidence:int,distance:int,boundaries:int,vedic:int,id:string,kind:string>>"


def moras(pattern: Column) -> Column:
    """A pattern with a character a mātrā: a heavy syllable is followed by LATER."""
    return F.replace(pattern, F.lit("G"), F.lit("G" + LATER))


def _none() -> Column:
    return F.array().cast(_CANDIDATE)


def _candidate(match: Column, evidence: Column, distance: Column, n_padas: Column, vedic: int, ident: Column, kind: Column) -> Column:
    """A candidate of a row with units, as numbers in the order in which candidates rank, then its id."""
    fields = {"match": match, "evidence": evidence, "distance": distance, "boundaries": F.greatest(F.lit(0), n_padas - F.size("units")), "vedic": F.lit(vedic)}
    return F.struct(*[x.cast("int").alias(name) for name, x in fields.items()], ident.alias("id"), kind.alias("kind"))


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """What a verse may meet by its number of syllables (meters by where their pādas end, Vedic classes), and by the stem
    of its first line."""
    words = range(-(-max(sum(map(len, r[6])) for r in dims.meter_rows()) // WORD))
    shapes: dict[int, dict[tuple, list]] = {}
    for r in dims.meter_rows():
        whole, ends = "".join(r[6]), tuple(sum(map(len, r[6][: i + 1])) for i in range(4))
        # Places that differ count, but a last one as the policy says: not where a light one stands for a heavy one.
        licence = ["" if i + 1 not in ends else "any" if r[9] == "bidirectional" else "light" if (r[9], c) == ("short-to-guru", "G") else "" for i, c in enumerate(whole)]
        bits = lambda marks: [int("".join(marks[k * WORD : (k + 1) * WORD]) or "0", 2) for k in words]
        numbers = bits(["01"[c == "G"] for c in whole]), bits(["01"[x == ""] for x in licence]), bits(["01"[x != "any"] for x in licence])
        shapes.setdefault(len(whole), {}).setdefault(ends, []).append((r[1], r[3], *numbers))
    classes: dict[int, list] = {}
    for base, ident, lengths, rank in dims.vedic_rows():
        classes.setdefault(sum(lengths), []).append((base, ident, len(lengths), rank, [sum(lengths[: i + 1]) for i in range(len(lengths))]))
    by_size = [(n, [(list(ends), x) for ends, x in shapes.get(n, {}).items()], classes.get(n, [])) for n in sorted({*shapes, *classes})]
    stems: dict[str, list] = {}
    for r in dims.meter_rows():
        if r[3] == "sama-vrtta":
            stems.setdefault(r[5][0][:-1], []).append((r[1], r[5][0][-1], r[9]))
    meters = "array<struct<id:string,kind:string,expected:array<bigint>,counted:array<bigint>,known:array<bigint>>>"
    sized = spark.createDataFrame(by_size, f"n int, shapes array<struct<ends:array<int>,meters:{meters}>>, classes array<struct<base:string,id:string,padas:int,grade:int,ends:array<int>>>")
    return F.broadcast(sized), F.broadcast(spark.createDataFrame(sorted(stems.items()), "stem string, single array<struct<id:string,last:string,policy:string>>"))


def _bits(marks: Column) -> Column:
    """Numbers of WORD binary digits each, of a string of them."""
    one = lambda k: F.coalesce(F.conv(F.substring(marks, k * WORD + 1, WORD), 2, 10).cast("long"), F.lit(0))
    return F.array(*[one(k) for k in range(-(-max(sum(map(len, r[6])) for r in dims.meter_rows()) // WORD))])


def _among(ends: Column) -> Column:
    """Whether a row's units end at none but these places, by cum."""
    return F.size(F.array_except("cum", ends)) == 0


def _varna() -> Column:
    """Exact and near matches of four-pāda meters: distance counts the places outside the pāda-final licence, which are
    the bits in which the numbers of two patterns differ."""

    def judged(m: Column) -> Column:
        def wrong(k: int) -> Column:
            differ = F.get("bits", F.lit(k)).bitwiseXOR(F.get(m["expected"], F.lit(k))).bitwiseAND(F.get(m["counted"], F.lit(k)))
            return F.bit_count(differ.bitwiseOR(F.get("odd", F.lit(k)).bitwiseAND(F.get(m["known"], F.lit(k)))))

        words = range(-(-max(sum(map(len, r[6])) for r in dims.meter_rows()) // WORD))
        total = reduce(lambda a, k: a + F.when(F.col("n") > k * WORD, wrong(k)).otherwise(0), words[1:], wrong(0))
        return F.struct(m["id"].alias("id"), m["kind"].alias("kind"), total.alias("wrong"))

    met = F.flatten(F.transform(F.filter("shapes", lambda s: _among(s["ends"])), lambda s: s["meters"]))
    return F.transform(F.transform(met, judged), lambda x: _candidate(F.when(x["wrong"] == 0, 0).otherwise(3), F.lit(0), x["wrong"], F.lit(4), 0, x["id"], x["kind"]))


def _upajati(split: Callable[[Column], Column]) -> Column:
    """Four pādas that each match one of two siblings, not all the same one; the first sibling wins. split: whether the
    units end at none but these places."""
    by_id = {r[1]: r for r in dims.meter_rows()}
    found = []
    for ident, _, *pair in dims.UPAJATI:
        size = len(by_id[pair[0]][5][0])
        first, second = (_member(by_id[x][5][0], by_id[x][9]) for x in pair)
        padas = F.array(*[F.substring("pattern", i * size + 1, size) for i in range(4)])
        met = (F.col("n") == 4 * size) & split(F.array(*[F.lit(i * size) for i in range(1, 5)]))
        mixed = F.forall(padas, lambda u: first(u) | second(u)) & F.exists(padas, first) & ~F.forall(padas, first)
        found.append(F.when(met & mixed, _candidate(F.lit(0), F.lit(0), F.lit(0), F.lit(4), 0, F.lit(ident), F.lit("upajati"))))
    return F.array_compact(F.array(*found))


def _counted(found: Column) -> Column:
    """The śloka by its cadences, and the āryā family by mātrās and feet: rules of a verse alone."""
    match = lambda x: F.when(x["wrong"] == 0, 0).when(x["else_type"] == "near", 3).otherwise(1)
    return F.transform(found, lambda x: _candidate(match(x), F.when(x["evidence"] == "full-verse", 0).otherwise(1), x["wrong"], x["padas"], 0, x["id"], x["kind"]))


def _vedic(split: Callable[[Column], Column]) -> Column:
    """Counts alone: exact lengths, or else one pāda a syllable shorter or longer. split as in _upajati()."""
    met = F.filter("classes", lambda c: split(c["ends"]))
    closest = lambda fit: F.filter(fit, lambda c: ~F.exists(fit, lambda d: (d["base"] == c["base"]) & (d["grade"] < c["grade"])))
    return F.transform(bound(met, closest), lambda c: _candidate(F.lit(1), F.lit(2), F.lit(0), c["padas"], 1, c["id"], F.lit("vedic")))


def _partial() -> Column:
    """One or two lines that each have the pattern of one meter of equal pādas."""

    def fits(m: Column) -> Column:
        last = lambda u: F.right(u, F.lit(1))
        return F.forall("units", lambda u: (F.length(u) == F.length("stem") + 1) & u.startswith(F.col("stem")) & ((m["last"] == last(u)) | _licensed(m["last"], last(u), m["policy"])))

    return F.transform(F.filter("single", fits), lambda m: _candidate(F.lit(2), F.lit(3), F.lit(0), F.lit(0), 0, m["id"], F.lit("sama-vrtta")))


def _others(rows: DataFrame) -> list[str]:
    return [x for x in rows.columns if x not in ("units", "asked")]


def listed(rows: DataFrame, include_near: bool = True) -> DataFrame:
    """Rows of (units, asked), a verse each, with their other columns, unit_patterns (the units), asked, pattern, n, cum, moras
    and `found`: its candidates as numbers, in their order. The other columns must have names of their own. A verse meets the fixed tables by broadcast joins on its size and its first line, and no verse is shuffled.

    Near matches, three at most, only where nothing exact nor a śloka is found; Vedic ones if asked for, or in auto
    without an exact classical one; partial ones where there is nothing else. A null among the units leaves none.
    """
    sized, stems = _tables(rows.sparkSession)
    made = rows.select(*_others(rows), "asked", F.col("units").alias("unit_patterns"), F.when(~F.exists("units", lambda u: u.isNull()), F.col("units")).alias("units"))
    made = made.withColumn("pattern", F.array_join("units", "")).withColumn("n", F.length("pattern")).withColumn("cum", prefix_sums(F.transform("units", F.length)))
    first = F.get("units", F.lit(0))
    made = made.withColumn("stem", F.when(F.size("units").between(1, 2), F.left(first, F.length(first) - 1))).withColumn("moras", moras(F.col("pattern")))
    made = made.join(sized, "n", "left").join(stems, "stem", "left")
    strange = F.col("pattern").rlike("[^LG]")
    kept = F.when(strange, F.regexp_replace("pattern", "[^LG]", "L")).otherwise(F.col("pattern"))
    met = F.col("shapes").isNotNull()
    made = made.withColumn("bits", F.when(met, _bits(F.translate(kept, "LG", "01")))).withColumn("odd", F.when(met, F.when(strange, _bits(F.regexp_replace(F.translate("pattern", "LG", "00"), "[^0]", "1"))).otherwise(F.array(*[F.lit(0).cast("long")] * 8))))
    every = F.concat(*[F.coalesce(x, _none()) for x in (_varna(), _upajati(_among), _counted(counted_candidates()))])
    made = made.withColumn("classical", F.when(F.col("asked") != "vedic", every).otherwise(_none()))
    # What is used several times is a column, else it is worked out each time.
    made = made.withColumn("whole", F.filter("classical", lambda c: c["match"] != 3))
    near = F.slice(F.sort_array(F.filter("classical", lambda c: c["match"] == 3)), 1, 3)
    blocked = F.exists("whole", lambda c: ((c["match"] == 0) & (c["kind"] != "upajati")) | (c["kind"] == "sloka"))
    settled = F.exists("whole", lambda c: c["match"] == 0)
    wanted = (F.col("asked") == "vedic") | ((F.col("asked") == "auto") & ~settled)
    made = made.withColumn("found", F.concat("whole", F.when(F.lit(include_near) & ~blocked, near).otherwise(_none()), F.when(wanted, F.coalesce(_vedic(_among), _none())).otherwise(_none())))
    made = made.withColumn("found", F.when(F.size("found") > 0, F.sort_array("found")).when(F.col("asked") != "vedic", F.sort_array(F.coalesce(_partial(), _none()))).otherwise(_none()))
    # Exploded as a whole, as a filter on what is made of it is derived down through it otherwise, and grows with each use.
    return made.select(*_others(rows), "asked", "unit_patterns", "pattern", "n", "cum", "moras", F.explode_outer(F.array("found")).alias("found"))


def _settling(spark: SparkSession) -> tuple[DataFrame, Column]:
    """What a verse may agree with but by nearness or as a single line, by its number of syllables; and whether a row of
    units, pattern and n may do so at all. A meter's stem is its pattern without the pādas' last places, which must be like
    `lasts`."""
    shapes: dict[int, dict[tuple, list]] = {}
    for r in dims.meter_rows():
        ends = tuple(sum(map(len, r[6][: i + 1])) for i in range(4))
        lasts = "(?s)...." if r[9] == "bidirectional" else "".join("[LG]" if (r[9], p[-1]) == ("short-to-guru", "G") else p[-1] for p in r[6])
        shapes.setdefault(ends[-1], {}).setdefault(ends, []).append((r[1], r[3], "".join(p[:-1] for p in r[6]), lasts))
    classes: dict[int, list] = {}
    for base, ident, lengths, rank in dims.vedic_rows():
        classes.setdefault(sum(lengths), []).append((base, ident, len(lengths), rank, [sum(lengths[: i + 1]) for i in range(len(lengths))]))
    by_size = [(n, [(list(ends), x) for ends, x in shapes.get(n, {}).items()], classes.get(n, [])) for n in sorted({*shapes, *classes})]
    meters = "array<struct<id:string,kind:string,stem:string,lasts:string>>"
    sized = spark.createDataFrame(by_size, f"n int, shapes array<struct<ends:array<int>,meters:{meters}>>, classes array<struct<base:string,id:string,padas:int,grade:int,ends:array<int>>>")
    most = max(len(lengths) for _, _, lengths in dims.VEDIC)
    totals = sorted({sum(quarters) for _, _, quarters, _ in dims.JATI})
    few = (F.size("units") <= most) & (F.col("n").isin([n for n, *_ in by_size]) | (2 * F.col("n") - F.length(F.translate("pattern", "G", ""))).isin(totals))
    return F.broadcast(sized), few | ((F.col("n") >= 32) & (F.col("n") % 16 == 0))


def settled(spark: SparkSession, others: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Of rows of (units, asked) and these other columns, a verse each: the others with the status and primary_id that
    verdicts() gives those whose first candidate is neither near nor partial, and nulls for all others. No unit is null
    or empty; where the units are null nothing is worked out. Near candidates, most of the work of listed(), are not made:
    a pattern meets meters by its stem, and only where its size, lines or mātrās allow a candidate. A function, as its
    many expressions are built once for several tables.
    """
    sized, may = _settling(spark)
    # A one wherever a unit ends.
    marks = F.array_join(F.transform("units", lambda u: F.lpad(F.lit("1"), F.length(u), F.lit("0"))), "")

    def split(ends: Column) -> Column:
        return F.size(F.filter(ends, lambda e: F.substr(F.col("marks"), e, F.lit(1)) == "1")) == F.size("units")

    def same(s: Column) -> Column:
        ends = [F.get(s["ends"], F.lit(i)) for i in range(4)]
        stem = F.concat(*[F.substr(F.col("pattern"), a + 1, b - a - 1) for a, b in zip([F.lit(0), *ends], ends, strict=False)])
        lasts = F.concat(*[F.substr(F.col("pattern"), b, F.lit(1)) for b in ends])
        return bound(stem, lambda x: F.filter(s["meters"], lambda m: (m["stem"] == x) & F.rlike(lasts, m["lasts"])))

    fixed = F.flatten(F.transform(F.filter("shapes", lambda s: split(s["ends"])), same))
    exact = F.transform(fixed, lambda m: _candidate(F.lit(0), F.lit(0), F.lit(0), F.lit(4), 0, m["id"], m["kind"]))
    every = F.concat(*[F.coalesce(x, _none()) for x in (exact, _upajati(split), _counted(F.array_compact(F.array(_sloka()))), _jati())])
    classical = F.when(F.col("n").isNotNull() & (F.col("asked") != "vedic"), every).otherwise(_none())
    wanted = F.col("n").isNotNull() & ((F.col("asked") == "vedic") | ((F.col("asked") == "auto") & ~F.exists("classical", lambda c: c["match"] == 0)))
    found = F.concat("classical", F.when(wanted, F.coalesce(_vedic(split), _none())).otherwise(_none()))
    full = (F.col("best.match") == 0) & (F.col("best.evidence") <= 1) & F.col("best.id").isin(*dims.DUAL_AUTHORITY)
    status = F.when(F.col("best").isNull(), None).when(tied(F.col("best")) > 1, "ambiguous").when(full, "identified").otherwise("provisional")
    kept = [F.when(F.col("may"), F.col(x)).alias(x) for x in ("units", "pattern", "n")]

    def judge(rows: DataFrame) -> DataFrame:
        made = rows.select(*others, "asked", "units", F.array_join("units", "").alias("pattern"))
        made = made.withColumn("n", F.length("pattern")).withColumn("may", may)
        made = made.select(*others, "asked", *kept).withColumn("marks", marks).join(sized, "n", "left")
        made = made.withColumn("classical", classical).withColumn("found", found).withColumn("best", F.array_min("found"))
        return made.select(*others, status.alias("status"), F.col("best.id").alias("primary_id"))

    return judge


def tied(c: Column) -> Column:
    """How many candidates of its row rank like this one, but for the id."""
    return F.size(F.filter("found", lambda d: (d["match"] == c["match"]) & (d["evidence"] == c["evidence"]) & (d["distance"] == c["distance"]) & (d["boundaries"] == c["boundaries"]) & (d["vedic"] == c["vedic"])))


def named_fields(c: Column) -> dict[str, Column]:
    """A candidate's numbers as words."""
    word = lambda words, x: F.get(F.array(*map(F.lit, words)), x)
    return {"id": c["id"], "kind": c["kind"], "tradition": F.when(c["vedic"] == 1, "vedic").otherwise("classical"), "match_type": word(MATCHES, c["match"]), "distance": c["distance"], "boundary_transformations": c["boundaries"], "evidence": word(EVIDENCE, c["evidence"])}


def exact_lookup(lines: DataFrame, pattern: str = "pattern") -> DataFrame:
    """lines with the meters of one pāda whose pattern they have, the last place free: a hash join on length and the
    rest of the pattern, which is the path for a large corpus."""
    meters = dims.meters(lines.sparkSession).where("kind = 'sama-vrtta'").select(F.col("id").alias("meter_id"), F.element_at("patterns", 1).alias("p"))
    keyed = meters.select("meter_id", F.length("p").alias("_n"), F.expr("left(p, length(p) - 1)").alias("_stem"))
    stem = F.expr(f"left({pattern}, length({pattern}) - 1)")
    return lines.withColumn("_n", F.length(pattern)).withColumn("_stem", stem).join(F.broadcast(keyed), ["_n", "_stem"], "left").drop("_n", "_stem")


def sloka_pada(pattern: Column, is_even: Column) -> Column:
    """(subtype, problems) of eight syllables."""
    odd = F.when(F.substr(pattern, F.lit(5), F.lit(3)) == "LGG", "pathyā").when(F.substr(pattern, F.lit(2), F.lit(6)) == "GLGGGG", "ma-vipulā").when(F.substr(pattern, F.lit(2), F.lit(6)).isin("GLGGLL", "GGGGLL"), "bha-vipulā").when(F.substr(pattern, F.lit(4), F.lit(4)) == "GLLL", "na-vipulā").when(F.substr(pattern, F.lit(4), F.lit(4)) == "GGLG", "ra-vipulā").otherwise("unclassified odd-pāda cadence")
    light = (F.substr(pattern, F.lit(2), F.lit(2)) == "LL").cast("int")
    even_wrong = (F.substr(pattern, F.lit(2), F.lit(3)) == "GLG").cast("int") + (F.substr(pattern, F.lit(5), F.lit(3)) != "LGL").cast("int")
    return F.struct(F.when(is_even, "even-pāda cadence").otherwise(odd).alias("subtype"), (light + F.when(is_even, even_wrong).otherwise(odd.startswith("unclassified").cast("int"))).alias("problems"))


def _half_problems(base: int, kind: str) -> Column:
    """Broken rules of a half verse that begins after `base` mātrās of a row's moras."""
    feet = dims.JATI_FEET[kind]
    starts = [base + sum(feet[:i]) for i in range(9)]
    raw = [F.substring("moras", starts[i] + 1, feet[i]) for i in range(8)]
    groups = [F.translate(x, LATER, "") for x in raw]
    problems = F.lit(0)
    for i, g in enumerate(groups):
        if feet[i] == 4:
            problems = problems + (~g.isin("GG", "GLL", "LGL", "LLG", "LLLL")).cast("int")
        if i % 2 == 0:
            problems = problems + (g == "LGL").cast("int")
    if kind in ("first", "aryagiti"):
        problems = problems + (~groups[5].isin("LGL", "LLLL")).cast("int")
    if kind != "aryagiti":
        problems = problems + (groups[7] != "G").cast("int")
    # A foot that ends inside a heavy syllable.
    split = [F.substring("moras", x + 1, 1) == LATER for x in starts[1:]]
    return F.when(reduce(Column.__or__, split), 1).otherwise(problems)


def _sloka() -> Column:
    """The śloka of counted_candidates(), or null."""
    padas = (F.col("n") / 8).cast("int")
    eights = (F.col("n") >= 32) & (F.col("n") % 16 == 0) & ~F.exists("units", lambda u: F.length(u) % 8 != 0)
    scans = F.transform(F.sequence(F.lit(0), F.greatest(padas, F.lit(1)) - 1), lambda i: sloka_pada(F.substr(F.col("pattern"), i * 8 + 1, F.lit(8)), i % 2 == 1))
    return F.when(eights, F.struct(F.lit("anustubh-sloka").alias("id"), F.lit("sloka").alias("kind"), F.lit("class-compatible").alias("else_type"), F.aggregate(scans, F.lit(0), lambda a, s: a + s["problems"]).alias("wrong"), padas.alias("padas"), F.when(padas == 4, "full-verse").otherwise("extended-stanza").alias("evidence")))


def _unit_matras() -> Column:
    """Where a row's units end, in mātrās."""
    return prefix_sums(F.transform("units", lambda u: F.length(u) + F.length(F.translate(u, "L", ""))))


def _half(kind: str) -> str:
    """What a half verse is that breaks no rule of _half_problems(), as a regular expression over its weights."""
    feet = dims.JATI_FEET[kind]
    said = []
    for i, size in enumerate(feet):
        if size == 4:
            may = ["LGL", "LLLL"] if i == 5 and kind in ("first", "aryagiti") else ["GG", "GLL", "LGL", "LLG", "LLLL"]
            said.append("(?:" + "|".join(x for x in may if i % 2 or x != "LGL") + ")")
        else:
            said.append("[^G]" if size == 1 else "G")
    return "".join(said)


def _jati() -> Column:
    """Candidates of the āryā family that break no rule."""
    found = []
    for ident, _, quarters, halves in dims.JATI:
        ends = F.array(*[F.lit(sum(quarters[: i + 1])) for i in range(4)])
        fits = F.rlike("pattern", F.lit("(?s)^" + "".join(map(_half, halves)) + "\\z")) & (F.size(F.array_except(_unit_matras(), ends)) == 0)
        found.append(F.when(fits, _candidate(F.lit(0), F.lit(0), F.lit(0), F.lit(4), 0, F.lit(ident), F.lit("jati"))))
    return F.array_compact(F.array(*found))


def counted_candidates() -> Column:
    """Of a row with units, pattern, n and moras: structs (id, kind, else_type, wrong, padas, evidence) of the śloka and the
    āryā family."""
    found = [_sloka()]
    unit_matras = _unit_matras()
    for ident, _, quarters, halves in dims.JATI:
        ends = [sum(quarters[: i + 1]) for i in range(4)]
        # The total first: few verses have it.
        fits = (F.length("moras") == ends[3]) & reduce(Column.__and__, [F.substring("moras", e + 1, 1) != LATER for e in ends]) & (F.size(F.array_except(unit_matras, F.array(*map(F.lit, ends)))) == 0)
        wrong = _half_problems(0, halves[0]) + _half_problems(ends[1], halves[1])
        found.append(F.when(fits, F.struct(F.lit(ident).alias("id"), F.lit("jati").alias("kind"), F.lit("near").alias("else_type"), wrong.alias("wrong"), F.lit(4).alias("padas"), F.lit("full-verse").alias("evidence"))))
    return F.array_compact(F.array(*found))


def candidates(units: DataFrame, tradition: str = "auto", include_near: bool = True) -> DataFrame:
    """All candidates of each verse with their rank and how many tie with it.

    tradition: auto, classical or vedic for all verses; a column `asked` of the units overrides it by verse. Which are
    listed is told at listed().
    """
    rows = listed(verses(units, tradition), include_near)
    ranked = F.transform("found", lambda c, i: F.struct(*[x.alias(name) for name, x in named_fields(c).items()], (i + 1).alias("rank"), tied(c).cast("long").alias("tied")))
    return rows.select("verse_id", "asked", F.explode_outer(ranked).alias("c")).where("c is not null").select("verse_id", "asked", "c.*")


def verdicts(rows: DataFrame) -> DataFrame:
    """Rows of (units, asked), a verse each, without these but with what identify() says of it; nothing is shuffled."""
    first = F.get("found", F.lit(0))
    named = F.when(first.isNotNull(), F.struct(*[x.alias(name) for name, x in named_fields(first).items()], tied(first).cast("long").alias("tied")))
    made = listed(rows).select(*_others(rows), F.explode_outer(F.array(named)).alias("c"))  # as in listed()
    full = (F.col("c.match_type") == "exact") & F.col("c.evidence").isin("full-verse", "extended-stanza")
    status = F.when(F.col("c").isNull(), "unidentified").when(F.col("c.match_type") == "partial", "insufficient-evidence").when(F.col("c.match_type") == "near", "unidentified").when(F.col("c.tied") > 1, "ambiguous").when(full & F.col("c.id").isin(*dims.DUAL_AUTHORITY), "identified").otherwise("provisional")
    return made.withColumn("status", status).select(*_others(rows), "status", (F.col("status") == "identified").alias("identified"), F.col("c.id").alias("primary_id"), "c.match_type", "c.distance", "c.boundary_transformations", "c.tied")


def identify(units: DataFrame, tradition: str = "auto") -> DataFrame:
    """verse_id, status, identified, primary_id, match_type, distance, boundary_transformations, tied."""
    return verdicts(verses(units, tradition))


def _member(expected: str, policy: str) -> Callable[[Column], Column]:
    """Whether a line is one of this pāda, its last place free as the policy says."""
    last = lambda u: F.right(u, F.lit(1))
    return lambda u: (F.left(u, F.length(u) - 1) == expected[:-1]) & ((last(u) == expected[-1]) | _licensed(F.lit(expected[-1]), last(u), F.lit(policy)))


def four_lines(rows: DataFrame, pattern: str, n: int) -> DataFrame:
    """rows with status, primary_id and distance of a stanza of four lines of n weights in the classical tradition, as
    identify() gives them, but within the row: no line is shuffled.

    Weights without the lines' last are the bits of a number, and those that differ from a meter the bits of the numbers'
    exclusive or; the last ones are compared as the meter's policy says. Patterns of another length than 4 n, null ones
    too, get nulls. Columns of the new names are replaced.
    """
    bits = lambda x: F.conv(F.translate(x, "LG", "01"), 2, 10).cast("long")
    of = lambda x: int(x.translate({76: 48, 71: 49}), 2)
    kept = [c for c in rows.columns if c not in ("status", "primary_id", "distance")]
    made = rows.select(F.struct(*kept).alias("row"), F.when(F.length(pattern) == 4 * n, F.col(pattern)).alias("pattern"))
    stem, last = F.regexp_replace("pattern", f"(.{{{n - 1}}}).", "$1"), F.regexp_replace("pattern", f".{{{n - 1}}}(.)", "$1")
    made = made.withColumn("stem", bits(stem)).withColumn("last", bits(last)).withColumn("units", F.regexp_extract_all("pattern", F.lit(f"(.{{{n}}})"), F.lit(1))).withColumn("n", F.length("pattern"))
    candidate = lambda match, evidence, distance, ident: F.struct(match.alias("match"), evidence.alias("evidence"), distance.cast("int").alias("distance"), ident.alias("id"))
    found = []
    for r in dims.meter_rows():
        if all(len(p) == n for p in r[6]):
            e = of("".join(p[-1] for p in r[6]))
            wrong = F.bit_count(F.col("stem").bitwiseXOR(F.lit(of("".join(p[:-1] for p in r[6])))))
            if r[9] != "bidirectional":  # a heavy last place where the meter has a light one is wrong
                wrong = wrong + F.bit_count(F.col("last").bitwiseAND(F.lit(15 ^ e)))
            found.append(candidate(F.when(wrong == 0, 0).otherwise(3), F.lit(0), wrong, F.lit(r[1])))
    by_id = {r[1]: r for r in dims.meter_rows()}
    for ident, _, *pair in dims.UPAJATI:
        members = [by_id[x] for x in pair]
        if len(members[0][5][0]) == n:
            fits = [_member(p[0], policy) for p, policy in ((m[5], m[9]) for m in members)]
            mixed = F.forall("units", lambda u: fits[0](u) | fits[1](u)) & ~F.forall("units", fits[0]) & ~F.forall("units", lambda u: ~fits[0](u))
            found.append(F.when(mixed, candidate(F.lit(0), F.lit(0), F.lit(0), F.lit(ident))))
    # The counted families need mātrās; a stanza whose lines don't last as theirs do is spared them.
    lengths = F.transform("units", lambda u: F.length(u) + F.length(F.translate(u, "L", "")))
    ends = {sum(q[: i + 1]) for _, _, q, _ in dims.JATI for i in range(4)}
    may = F.lit(n % 8 == 0) | F.forall(prefix_sums(lengths), lambda x: x.isin(*ends))
    shaped = made.withColumn("may", may).withColumn("moras", F.when(F.col("may"), moras(F.col("pattern"))))
    counted_here = F.transform(counted_candidates(), lambda x: candidate(F.when(x["wrong"] == 0, 0).when(x["else_type"] == "near", 3).otherwise(1), F.when(x["evidence"] == "full-verse", 0).otherwise(1), x["wrong"], x["id"]))
    fixed = F.array_compact(F.array(*found)) if found else F.slice(counted_here, 1, 0)
    shaped = shaped.withColumn("every", F.when(F.col("may"), F.concat(fixed, counted_here)).otherwise(fixed)).withColumn("best", F.when(F.col("pattern").isNotNull(), F.array_min("every")))
    tied = F.size(F.filter("every", lambda x: (x["match"] == F.col("best.match")) & (x["evidence"] == F.col("best.evidence")) & (x["distance"] == F.col("best.distance"))))
    status = F.when(F.col("best").isNull() | (F.col("best.match") == 3), "unidentified").when(tied > 1, "ambiguous").when((F.col("best.match") == 0) & F.col("best.id").isin(*dims.DUAL_AUTHORITY), "identified").otherwise("provisional")
    return shaped.select("row.*", F.when(F.col("pattern").isNotNull(), status).alias("status"), F.col("best.id").alias("primary_id"), F.col("best.distance").alias("distance"))


def catalog_violations(meters: DataFrame) -> DataFrame:
    """(id, problem): bad ids, form counts, alphabets, feet that don't give the pattern, caesuras, duplicates."""
    from kavyamill.functions.prosody import expand_feet

    forms = F.when(F.col("kind").isin("sama-vrtta", "dandaka"), 1).when(F.col("kind") == "ardhasama-vrtta", 2).otherwise(4)
    size = F.length(F.element_at("patterns", 1))
    rising = F.coalesce(F.forall(F.sequence(F.lit(1), F.size("yati")), lambda i: (F.element_at("yati", i) < size) & (F.element_at("yati", i) > F.when(i > 1, F.element_at("yati", F.greatest(i - 1, F.lit(1)))).otherwise(0))), F.lit(True))
    checks = {
        "id": ~F.col("id").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"),
        "forms": F.size("patterns") != forms,
        "alphabet": F.exists("patterns", lambda p: ~p.rlike("^[GL]+$")),
        "feet": F.exists(F.arrays_zip("feet", "patterns"), lambda x: ~expand_feet(x["feet"]).eqNullSafe(x["patterns"])),
        "yati": F.col("yati").isNotNull() & ~rising,
        "duplicate id": F.count("*").over(Window.partitionBy("id")) > 1,
        "duplicate form": F.count("*").over(Window.partitionBy("kind", "patterns", "terminal_policy")) > 1,
    }
    found = meters.withColumn("problem", F.filter(F.array(*[F.when(bad, name) for name, bad in checks.items()]), lambda x: x.isNotNull()))
    return found.select("id", F.explode("problem").alias("problem"))
