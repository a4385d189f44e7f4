"""Syllable tables of verses with their places in the source, and a second reading that must agree with them.

The maker cuts a pāda into units (a letter or digraph with the marks that combine with it), gives each its sounds, and
writes after each as many dots as it has source characters. A syllable is then a pattern over sounds and dots, and its
place in the source is the number of dots before it: spans live through composition, joiners and punctuation without
one row a character. The checker reads the written form alone, letter by letter, with a table of classes and states.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kavyamill.functions import prosody as P
from kavyamill.functions import text as X
from kavyamill.functions.akshara import RULES
from kavyamill.operators.verse import boundary_mode

# What is written without a sound of its own, roman letters that are written as two, and those with marks.
UNVOICED = "\\s\u200b\u200c\u200d\ufeff\\-\u2010\u2011\u2013\u2014'\u2019\u2018\u201c\u201d`,;.!?\"()ऽ।॥|"
ROMAN_PAIRS = "kh|gh|ch|jh|th|dh|ph|bh|ṭh|ḍh|ai|au"
MARKED = "āīūṝṛḹḷṃṁḥṅñṇṭḍśṣ"
#: Stand for a source character with sound, and for one without.
SOUND, SILENT = "\ue000", "\ue001"
#: Stand for the end of a part of a joined text, for a digit that is read, and in a source for one of these four.
END, DIGIT, OTHER = "\ue002", "\ue003", "\ue00f"
#: Characters of a block of a text that is cut at many places.
BLOCK = 512
#: Letters and digits that no reading of roman text knows, as they stand, whatever marks follow them.
FOREIGN = "FQWXZfqwxz0-24-9À-ÐÒ-ÖØ-ðò-öø-ÿ"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + MARKED.upper()

_V, _M = P.VOWELS, P.MARKS
_UNIT = rf"(?i:(?:{ROMAN_PAIRS})(?!\p{{M}})|\P{{M}}\p{{M}}*|\p{{M}}+)"
SYLLABLE = "struct<index:int,pada_index:int,position:int,text:string,iast:string,deva:string,onset:string,vowel:string,mark:string,coda:string,weight:string,matras:int,rule:string,reason:string,anceps:boolean,pluta:boolean,next_iast:string,pada_final:boolean,start:int,end:int,line:int,column:int,end_line:int,end_column:int,source:string>"
_FIELDS = [x.split(":")[0] for x in SYLLABLE[7:-1].split(",")]


def composed(text: Column) -> Column:
    """Letters of roman Sanskrit with combining marks as one character each."""
    for one in MARKED:
        text = F.replace(text, F.lit(unicodedata.normalize("NFD", one)), F.lit(one))
    return text


def source_padas(text: Column, mode: Column) -> Column:
    """(start, text) of each written line or part: with the places from 0, without blanks, dandas and verse numbers at
    its ends. Parts without anything else are left out."""
    by_line = F.regexp_extract_all(text, F.lit(r"([^\r\n]*)(\r\n|\r|\n|$)"), F.lit(0))
    by_danda = F.regexp_extract_all(text, F.lit(r"([^।॥|]*)([।॥|]+|$)"), F.lit(0))
    raw = F.when(mode == "lines", by_line).when(mode == "dandas", by_danda).otherwise(F.array(text))
    placed = P.bound(raw, lambda parts: F.zip_with(parts, P.prefix_sums(F.transform(parts, F.char_length)), lambda part, end: F.struct(part.alias("part"), (end - F.char_length(part)).alias("start"))))
    lead = lambda p: F.char_length(F.regexp_extract(p, r"^[\s।॥|]*", 0))
    body = lambda p: F.regexp_replace(p, r"^[\s।॥|]+|(?:[।॥|]\s*[0-9०-९]+)?[\s।॥|]*$", "")
    trimmed = F.transform(placed, lambda x: F.struct((x["start"] + lead(x["part"])).alias("start"), body(x["part"]).alias("text")))
    return F.filter(trimmed, lambda x: ~x["text"].rlike(r"^[0-9०-९]*$"))


def _dotted(text: Column, script: Column) -> Column:
    """Sounds of a pāda, each unit followed by its source characters as SOUND or SILENT ones. A unit has sounds of one
    character each, none, or ? for what can't be read. Units are read together, with END after each, which no rule knows."""
    return P.bound(F.regexp_replace(F.translate(text, SOUND + SILENT + END + DIGIT, OTHER * 4), _UNIT, "$0" + END), lambda units: _read(units, script))


def _read(units: Column, script: Column) -> Column:
    voiced = F.regexp_replace(units, f"(?<![^{END}])[{UNVOICED}][^{END}]*+", "")
    marked = F.regexp_replace(voiced, f"(?<![^{END}])[3३](?={END})", DIGIT)
    # Letters whose lower case is known are translated, which is much faster than the general way.
    known = F.translate(marked, _UPPER, _UPPER.lower())
    lowered = F.when(marked.rlike(f"[^\\x00-\\x7F{_UPPER}{_UPPER.lower()}{END}{DIGIT}]"), F.lower(marked)).otherwise(known)
    roman = P.canonical_lower(composed(lowered))
    read = F.when(script == "devanagari", F.translate(X.deva_to_slp1(F.replace(marked, F.lit(":"), F.lit("ः"))), "'", "")).otherwise(F.translate(roman, "~", "M"))
    sounds = F.translate(F.regexp_replace(F.translate(read, "~", "M"), f"[^{P.ALPHABET}{END}{DIGIT}]", "?"), DIGIT, "3")
    dots = F.regexp_replace(units, f"[^{END}]", SOUND)
    return F.array_join(F.zip_with(F.split(sounds, END), F.split(dots, END), lambda s, d: F.when(s == "", F.translate(d, SOUND, SILENT)).otherwise(F.concat(s, d))), "")


def _point(text: Column, offset: Column) -> Column:
    before = F.regexp_replace(F.substr(text, F.lit(1), offset), r"\r\n?", "\n")
    return F.struct((F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line"), (F.length(F.regexp_extract(before, r"([^\n]*)\z", 1)) + 1).alias("column"))


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _cut(text: Column, blocks: Column, start: Column, size: Column) -> Column:
    """`size` characters of a text after `start`, found in two blocks of it, and in the whole only where they are longer."""
    k = F.floor(start / BLOCK).cast("int")
    return F.when(size <= BLOCK, F.substr(F.concat(F.get(blocks, k), F.coalesce(F.get(blocks, k + 1), F.lit(""))), start - k * BLOCK + 1, size)).otherwise(F.substr(text, start + 1, size))


def analyses(verses: DataFrame, spelled: bool = True) -> DataFrame:
    """A row for each pāda of (verse_id, text): verse_id, pada_index, source (the verse), script, normalized, unread,
    pattern, matras and syllables, an array of SYLLABLE in order.

    Null and blank verses, and those without a pāda, have no row. What can't be read as Sanskrit stands in `unread` and
    the pāda has no syllables. Give each verse its own id. A verse is read in its row, and nothing is shuffled; what
    syllables have in common is worked out for a pāda's syllables at once, joined with END, in time linear in its length.
    Without `spelled` a roman pāda with one of FOREIGN is read no further: it is unread (unknown-character) whatever else
    it holds, and only its `normalized` is another, ? alone.
    """
    rows = verses.select("verse_id", F.col("text").alias("source"), X.script_strict(F.col("text")).alias("script"), boundary_mode(F.col("text")).alias("mode"))
    rows = rows.select("verse_id", "source", "script", source_padas(F.col("source"), F.col("mode")).alias("padas"))
    dots, sound = f"[{SOUND}{SILENT}]*+", f"[^{_V}{_M}3{SOUND}{SILENT}]"
    # Possessive groups: others go one call deeper for each letter of a long text.
    syllable = f"(?:{sound}{dots})*+[{_V}](?:{dots}3)?+(?:{dots}[{_M}])?+"
    last = f"(?:{dots}{sound})*+"
    # Each piece: silence before, the syllable with all dots inside it, and those of its last sound.
    cut = lambda p: F.regexp_extract_all(p["dotted"], F.lit(f"({SILENT}*)({syllable}(?:(?=[^{_V}]*$){last})?{SOUND}*)"), F.lit(0))
    left = lambda p: F.regexp_replace(p["bare"], f"[^{_V}{_M}3?]*+[{_V}]3?+[{_M}]?+", "")
    foreign = lambda p: F.lit(not spelled) & (F.col("script") != "devanagari") & p["text"].rlike(f"[{FOREIGN}]")
    steps = {"dotted": lambda p: F.when(foreign(p), "?").otherwise(_dotted(p["text"], F.col("script"))), "bare": lambda p: F.translate(p["dotted"], SOUND + SILENT, ""), "good": lambda p: p["bare"].rlike(f"[{_V}]") & ~left(p).rlike(f"[{_M}3?]"), "pieces": lambda p: F.when(p["good"], cut(p)).otherwise(F.array().cast("array<string>"))}
    adding = lambda name, step: lambda p: p.withField(name, step(p))
    for name, step in steps.items():  # a column for each, so that what is used twice is worked out once
        rows = rows.withColumn("padas", F.transform("padas", adding(name, step)))
    rows = rows.withColumn("totals", P.prefix_sums(F.transform("padas", lambda p: F.size(p["pieces"]))))
    rows = rows.select("verse_id", "source", "script", F.posexplode_outer(F.arrays_zip(F.col("padas").alias("p"), F.col("totals").alias("total"))).alias("pada_index", "x")).where("x is not null")
    rows = rows.select("verse_id", "source", "script", "pada_index", "x.p.*", (F.col("x.total") - F.size("x.p.pieces")).alias("before")).withColumn("joined", F.array_join("pieces", END))
    n = F.size("pieces")
    parts = lambda text: F.when(n > 0, F.split(text, END)).otherwise(F.array().cast("array<string>"))
    counts = lambda text: F.transform(parts(text), F.char_length)
    following = lambda name: F.slice(name, F.lit(2), F.greatest(F.size(name), F.lit(1)))
    rows = rows.withColumn("slp1", F.translate("joined", SOUND + SILENT, "")).withColumn("dots", F.regexp_replace("joined", f"[^{SOUND}{SILENT}{END}]++", ""))
    head = f"[^{_V}{END}]*+[{_V}]"
    rows = rows.withColumn("latin", X.slp1_to_iast(F.col("slp1"))).withColumn("onsets", F.regexp_replace("slp1", f"([^{_V}{END}]*+)[{_V}][^{END}]*+", "$1"))
    rows = rows.withColumns({
        "sizes": counts(F.col("dots")), "silences": counts(F.regexp_replace("dots", f"{SOUND}[^{END}]*+", "")), "iast": parts(F.col("latin")), "deva": parts(F.replace(X.lowered_to_deva(F.col("latin")), F.lit("3"), F.lit("३"))), "onset": parts(X.slp1_to_iast(F.col("onsets"))), "crowds": counts(F.col("onsets")),
        "vowel": parts(X.slp1_to_iast(F.regexp_replace("slp1", f"[^{_V}{END}]*+([{_V}])[^{END}]*+", "$1"))), "mark": parts(X.slp1_to_iast(F.regexp_replace("slp1", f"{head}3?+([{_M}]?+)[^{END}]*+", "$1"))), "coda": parts(X.slp1_to_iast(F.regexp_replace("slp1", f"{head}3?+[{_M}]?+([^{END}]*+)", "$1"))),
        "from": _point(F.col("source"), F.col("start")), "blocks": F.when(F.col("good"), _blocks(F.col("text"))),
    })
    long = [dict(zip(X.SLP1_VOWELS, X.DEVA_VOWELS.values(), strict=True))[v] for v in P.LONG]
    rule = lambda x: F.when(F.contains(x["iast"], F.lit("3")), "pluta-guru").when(x["vowel"].isin(*long), "dirgha-guru").when(x["mark"] != "", "mark-guru").when(x["coda"] != "", "closed-guru").when(x["crowd"] >= 2, "position-guru").otherwise("hrasva-laghu")
    rows = rows.withColumn("ends", P.prefix_sums(F.col("sizes"))).withColumn("next", following("iast")).withColumn("crowd", following("crowds"))
    rows = rows.withColumn("rules", F.transform(F.arrays_zip("iast", "vowel", "mark", "coda", "crowd"), rule))
    rows = rows.withColumn("zipped", F.arrays_zip("iast", "deva", "onset", "vowel", "mark", "coda", "next", F.col("rules").alias("rule"), F.col("sizes").alias("size"), F.col("silences").alias("silence"), F.col("ends").alias("end")))
    authority = F.create_map(*[F.lit(y) for r, a in RULES.items() for y in (r, f"{'laghu' if r == 'hrasva-laghu' else 'guru'} by {r} ({a})")])

    def made(x: Column, i: Column) -> Column:
        start, end, pluta = x["end"] - x["size"] + x["silence"], x["end"], x["rule"] == "pluta-guru"
        light = x["rule"] == "hrasva-laghu"
        # A pāda holds no line break, so all its places are in the line where it begins.
        line, column = F.col("from.line"), F.col("from.column")
        values = [F.col("before") + i, F.col("pada_index"), i, F.when(F.col("script") == "devanagari", x["deva"]).otherwise(x["iast"]), x["iast"], x["deva"], x["onset"], x["vowel"], x["mark"], x["coda"], F.when(light, "laghu").otherwise("guru"), F.when(pluta, 3).when(light, 1).otherwise(2), x["rule"], F.element_at(authority, x["rule"]), i == n - 1, pluta, F.coalesce(x["next"], F.lit("")), i == n - 1, F.col("start") + start, F.col("start") + end, line, column + start, line, column + end, _cut(F.col("text"), F.col("blocks"), start, end - start)]
        return F.struct(*[v.alias(name) for v, name in zip(values, _FIELDS, strict=True)])

    rows = rows.withColumn("syllables", F.transform("zipped", made).cast(f"array<{SYLLABLE}>"))
    unread = F.when(~F.col("good"), F.when(F.contains("bare", F.lit("?")), "unknown-character").when(~F.col("bare").rlike(f"[{_V}]"), "no-vowel").otherwise("misplaced-mark"))
    pattern = F.array_join(F.transform("rules", lambda x: F.when(x == "hrasva-laghu", "L").otherwise("G")), "")
    matras = F.when(F.col("good"), P.matras(pattern) + F.char_length("slp1") - F.char_length(F.replace("slp1", F.lit("3"), F.lit("")))).otherwise(0)
    # Blanks stay, and stand where two sounds would be read as one.
    apart = F.regexp_replace(F.regexp_replace(F.translate("dotted", SOUND, ""), f"{SILENT}+", " "), "(a)(?=[iu])|([kgcjwqtdpb])(?=h)", "$1$2 ")
    return rows.select("verse_id", "pada_index", "source", "script", X.slp1_to_iast(apart).alias("normalized"), unread.alias("unread"), "syllables", pattern.alias("pattern"), matras.alias("matras"))


#: Classes of the written form, for the checker alone: each letter's, then what a letter is after one of another class.
_CLASS = {"a": "A", "i": "I", "u": "U", **dict.fromkeys("āīūṛṝḷḹeo", "V"), **dict.fromkeys("kgcjṭḍtdpb", "K"), "h": "H", **dict.fromkeys("ṅñṇnmyrlvśṣsḻ", "C"), **dict.fromkeys("ṃṁḥ", "N"), "3": "P", " ": "T"}
_ALONE = {"A": "V", "I": "V", "U": "V", "V": "V", "K": "O", "H": "O", "C": "O", "N": "M", "P": "P", "T": "t"}
_AFTER = {("A", "I"): "v", ("A", "U"): "v", ("K", "H"): "o"}
MOVES = {before + now: _AFTER.get((before, now), alone) for before in _ALONE for now, alone in _ALONE.items()}
#: How a syllable is weighed, the first that holds: rule, mātrās.
_WEIGHED = (("pluta-guru", 3), ("dirgha-guru", 2), ("mark-guru", 2), ("closed-guru", 2), ("position-guru", 2), ("hrasva-laghu", 1))
_HEAD = "(?:[Oo].)*+V.(?:v.)?+(?:P.)?+"
_READ = _HEAD + "(?:M.)?+"


#: Stand for the moves while letters are read, as letters are written like some of them.
_MARKS = dict(zip("VvOoPMX", "\ue010\ue011\ue012\ue013\ue014\ue015\ue016", strict=True))


def _reread(normalized: Column) -> Column:
    """The written form with each letter's move before it: O and o begin and go on a consonant, V and v a vowel, P is a
    pluta, M a mark; blanks are gone. A state is the class before, so a letter needs only one look back: first those
    whose move the letter before changes are marked, then the others by their class."""
    of = lambda kind: "".join(c for c, k in _CLASS.items() if k == kind)
    every, seen = "".join(_MARKS.values()), "".join(_CLASS)
    out = F.translate(normalized, every, "?" * len(every))
    for (before, now), move in _AFTER.items():
        out = F.regexp_replace(out, f"(?<=[{of(before)}])[{of(now)}]", _MARKS[move] + "$0")
    for move in "VOPM":
        out = F.regexp_replace(out, f"(?<![{every}])[{''.join(of(k) for k, m in _ALONE.items() if m == move)}]", _MARKS[move] + "$0")
    out = F.regexp_replace(out, f"(?s)[^{seen}{every}]", _MARKS["X"] + "$0")
    return F.translate(F.translate(out, of("T"), ""), every, "".join(_MARKS))


def _expected(cut: Column) -> Column:
    """What the syllables of a pāda must be, from the moves and letters of all, each with END after it but the last."""
    n, one = F.size(cut), f"[^{END}]"
    first = f"(?<!{one})"
    head = f"(?:[Oo]{one})*+V{one}(?:v{one})?+"
    written = lambda x: F.regexp_replace(x, f"[OoVvPM]({one})", "$1")
    parts = lambda x: F.when(n > 0, F.split(x, END)).otherwise(F.array().cast("array<string>"))
    following = lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x), F.lit(1)))

    def of_joined(joined: Column) -> Column:
        part = lambda pattern: F.regexp_replace(joined, f"{first}{pattern}{one}*+", "$1")
        onset = part(f"((?:[Oo]{one})*+)V")
        crowd = F.regexp_replace(F.regexp_replace(onset, f"o{one}", ""), f"O{one}", "O")
        shown = written(joined)
        deva = F.replace(X.lowered_to_deva(shown), F.lit("3"), F.lit("३"))
        columns = {"iast": shown, "deva": deva, "onset": written(onset), "vowel": written(part(f"(?:[Oo]{one})*+(V{one}(?:v{one})?+)")), "mark": written(part(f"{head}(?:P{one})?+((?:M{one})?+)")), "coda": written(part(f"{head}(?:P{one})?+(?:M{one})?+((?:[Oo]{one})*+)")), "pluta": part(f"{head}((?:P{one})?+)")}
        crowds = F.transform(following(parts(crowd)), F.char_length)
        return F.arrays_zip(*[parts(x).alias(name) for name, x in columns.items()], following(parts(shown)).alias("next"), crowds.alias("crowd"))

    def weighed(x: Column) -> Column:
        pluta = x["pluta"] != ""
        holds = [pluta, x["vowel"].isin("ā", "ī", "ū", "ṝ", "ḹ", "e", "ai", "o", "au"), x["mark"] != "", x["coda"] != "", x["crowd"] >= 2]
        which = F.lit(len(holds) + 1)
        for k in reversed(range(len(holds))):
            which = F.when(holds[k], k + 1).otherwise(which)
        return F.struct(*[x[name].alias(name) for name in ("iast", "deva", "onset", "vowel", "mark", "coda")], pluta.alias("pluta"), F.coalesce(x["next"], F.lit("")).alias("next_iast"), which.alias("which"))

    def ruled(x: Column) -> Column:
        rule, matras = (F.element_at(F.array(*[F.lit(y[k]) for y in _WEIGHED]), x["which"]) for k in (0, 1))
        return F.struct(*[x[name].alias(name) for name in ("iast", "deva", "onset", "vowel", "mark", "coda", "pluta", "next_iast")], F.when(x["which"] == len(_WEIGHED), "laghu").otherwise("guru").alias("weight"), matras.alias("matras"), rule.alias("rule"))

    return F.transform(F.transform(P.bound(F.array_join(cut, END), of_joined), weighed), ruled)


def _judged(analysis: DataFrame) -> DataFrame:
    """Pādas of analyses() with faults, an array of (position, code), and disordered, true in one row of a verse whose pādas
    aren't in order. Syllables are judged in their row; what is gathered by verse is counts and faults alone."""
    readable = F.col("unread").isNull()
    # The source of a pāda that is not judged is its verse's key alone.
    read = analysis.select("verse_id", "pada_index", "script", F.sha2("source", 256).alias("text_key"), F.when(readable, F.col("source")).alias("source"), "unread", "pattern", "matras", "syllables", F.when(readable, _reread(F.col("normalized"))).otherwise("").alias("read"))
    valid = (F.col("read") != "") & F.col("left").rlike("^(?:[Oo].)*+$") & (F.col("left") != F.col("read"))
    rows = read.withColumn("left", F.regexp_replace("read", _READ, "")).withColumn("valid", valid)
    rows = rows.withColumn("cut", F.when(F.col("valid"), F.regexp_extract_all("read", F.lit(f"({_READ}(?:(?:[Oo].)++$)?+)"), F.lit(1))).otherwise(F.array().cast("array<string>")))
    # Where each line break's first character ends, and where the break does: a place knows its line by those before it.
    ended = F.regexp_extract_all("source", F.lit(r"([^\r\n]*+(?:\r\n|\r|\n|$))"), F.lit(1))
    breaks = F.filter(ended, lambda x: x.endswith("\n") | x.endswith("\r"))
    rows = rows.withColumn("expected", _expected(F.col("cut"))).withColumn("lines", breaks).withColumn("until", P.prefix_sums(F.transform("lines", F.char_length)))
    rows = rows.withColumn("breaks", F.zip_with("lines", "until", lambda x, end: F.struct((end - F.when(x.endswith("\r\n"), 1).otherwise(0)).alias("at"), end.alias("end")))).withColumn("length", F.char_length("source")).withColumn("blocks", _blocks(F.col("source")))
    size = F.size("cut")

    def located(offset: Column, line: Column, column: Column) -> Column:
        within = F.least(F.greatest(offset, F.lit(0)), F.col("length"))
        before = F.filter("breaks", lambda b: b["at"] <= within)
        several = P.bound(before, lambda b: (line == F.size(b) + 1) & (column == F.greatest(within - F.coalesce(F.get(b, F.size(b) - 1)["end"], F.lit(0)), F.lit(0)) + 1))
        return F.when(F.size("breaks") == 0, (line == 1) & (column == within + 1)).otherwise(several)

    authority = F.create_map(*[F.lit(y) for rule, a in RULES.items() for y in (rule, f" by {rule} ({a})")])

    def faults(both: Column, i: Column) -> Column:
        a, e = both["actual"], both["expected"]
        inside = (a["start"] >= 0) & (a["end"] > a["start"]) & (a["end"] <= F.col("length"))
        same = lambda name: a[name].eqNullSafe(e[name])
        good = {
            "PADA_INDEX_MISMATCH": a["pada_index"] == F.col("pada_index"), "POSITION_MISMATCH": a["position"] == i, "TEXT_MISMATCH": same("iast"),
            "PARTS_MISMATCH": same("onset") & same("vowel") & same("mark") & same("coda"), "WEIGHT_MISMATCH": same("weight"), "MATRAS_MISMATCH": same("matras"), "RULE_MISMATCH": same("rule"),
            "REASON_MISMATCH": a["reason"] == F.concat(e["weight"], F.element_at(authority, e["rule"])), "ANCEPS_MISMATCH": a["anceps"] == (i == size - 1), "PLUTA_MISMATCH": same("pluta"),
            "CONTEXT_MISMATCH": same("next_iast"), "FINAL_CONTEXT_MISMATCH": a["pada_final"] == (i == size - 1), "DEVA_MISMATCH": a["deva"] == e["deva"], "DISPLAY_MISMATCH": a["text"] == F.when(F.col("script") == "iast", e["iast"]).otherwise(e["deva"]),
            "SPAN_BOUNDS_INVALID": inside, "SOURCE_MISMATCH": ~inside | (a["source"] == _cut(F.col("source"), F.col("blocks"), a["start"], a["end"] - a["start"])), "SPAN_LOCATION_MISMATCH": ~inside | (located(a["start"], a["line"], a["column"]) & located(a["end"], a["end_line"], a["end_column"])),
        }
        named = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(i.alias("position"), F.lit(code).alias("code"))) for code, ok in good.items()]))
        return F.when(a.isNotNull() & e.isNotNull() & ~F.coalesce(reduce(Column.__and__, good.values()), F.lit(False)), named)

    of_syllables = F.flatten(F.array_compact(F.transform(F.arrays_zip(F.col("syllables").alias("actual"), F.col("expected").alias("expected")), faults)))
    pattern = F.array_join(F.transform("expected", lambda e: F.when(e["weight"] == "guru", "G").otherwise("L")), "")
    ok = F.col("valid")
    whole = {"CHECKER_PARSE_FAILED": ok, "PADA_COUNT_MISMATCH": ~ok | (F.size("syllables") == size), "PATTERN_MISMATCH": ~ok | (F.col("pattern") == pattern), "PADA_MATRAS_MISMATCH": ~ok | (F.col("matras") == F.aggregate("expected", F.lit(0), lambda a, e: a + e["matras"]))}
    of_pada = F.array_compact(F.array(*[F.when(~F.coalesce(fine, F.lit(False)), F.struct(F.lit(None).cast("int").alias("position"), F.lit(code).alias("code"))) for code, fine in whole.items()]))
    # Numbers in the verse are compared where it is gathered: only how far each is from its place goes there, and one for all where they agree.
    offsets = F.transform(F.slice("syllables", F.lit(1), F.least(F.size("syllables"), size)), lambda x, i: x["index"] - i)
    rows = rows.select("verse_id", "text_key", "pada_index", "unread", "pattern", "matras", F.when(readable, size).otherwise(0).alias("size"), F.when(readable, F.concat(of_pada, of_syllables)).alias("found"), F.when(readable, offsets).otherwise(F.array().cast("array<int>")).alias("offsets"))
    rows = rows.withColumn("numbered", F.size("offsets")).withColumn("offsets", F.when(F.size(F.array_distinct("offsets")) == 1, F.slice("offsets", 1, 1)).otherwise(F.col("offsets"))).repartition("verse_id")
    order = Window.partitionBy("verse_id", "text_key").orderBy("pada_index")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n, places = F.count("*").over(every), F.size(F.collect_set("pada_index").over(every))
    disordered = (F.min("pada_index").over(every) != 0) | (F.max("pada_index").over(every) != n - 1) | (places != n)
    rows = rows.withColumns({"first": first, "wrong": disordered, "place": F.row_number().over(order)})
    right = (F.size("offsets") == 1) & (F.get("offsets", F.lit(0)) == F.col("first"))
    off = lambda i: F.get("offsets", F.when(F.size("offsets") == 1, 0).otherwise(i))
    misnumbered = F.filter(F.transform(F.filter(F.sequence(F.lit(0), F.col("numbered")), lambda i: i < F.col("numbered")), lambda i: F.struct(i.alias("position"), F.lit("INDEX_MISMATCH").alias("code"))), lambda x: ~F.coalesce(off(x["position"]) == F.col("first"), F.lit(False)))
    none = F.array().cast("array<struct<position:int,code:string>>")
    index = F.when((F.col("numbered") > 0) & ~F.coalesce(right, F.lit(False)), misnumbered).otherwise(none)
    return rows.select("verse_id", "pada_index", "unread", "pattern", "matras", F.when(readable, F.concat("found", index)).otherwise(none).alias("faults"), (F.col("wrong") & (F.col("place") == 1)).alias("disordered"))


def recheck(analysis: DataFrame) -> DataFrame:
    """(verse_id, pada_index, position, code) for each thing in which a second reading differs from analyses(): none for
    a right one. position is null for a whole pāda's faults, pada_index too for a verse's.

    Of a syllable 18 things are checked, of a pāda its reading, count, pattern and mātrās, of a verse the order of its
    pādas. Syllables are matched by place, the longer list against nothing. Pādas that the maker could not read are
    not checked. Syllables are judged in their row; only counts and faults are gathered by verse.
    """
    nothing = F.lit(None).cast("int")
    of_pada = F.transform("faults", lambda f: F.struct(F.col("pada_index").alias("pada_index"), f["position"].alias("position"), f["code"].alias("code")))
    of_verse = F.when(F.col("disordered"), F.array(F.struct(nothing.alias("pada_index"), nothing.alias("position"), F.lit("PADA_ORDER_MISMATCH").alias("code")))).otherwise(F.slice(of_pada, 1, 0))
    found = _judged(analysis).where("size(faults) > 0 or disordered").select("verse_id", F.explode_outer(F.concat(of_pada, of_verse)).alias("f")).where("f is not null")
    return found.select("verse_id", "f.pada_index", "f.position", "f.code")


def verified(verses: DataFrame) -> DataFrame:
    """verse_id, script, padas, syllables, laghu, guru, matras, errors, status and ok of every verse, null ones too.

    errors: mixed-script, no-letters, ascii-scheme, and what pādas could not be read for. status is not-run with an
    error or without a syllable, failed if recheck() has a row, else verified; ok only then. Verses of one roman pāda with
    one of FOREIGN are known to be unread and meet the others where pādas are counted; those are dealt over tasks by number.
    A verse that is known to have an error is read for its counts, but not a second time.
    """
    text, script = F.col("text"), X.script_strict(F.col("text"))
    flags = {"mixed-script": script == "mixed", "no-letters": script == "none", "ascii-scheme": (script == "iast") & X.ascii_scheme_guard(text)}
    # With a roman letter there is a pāda, and without a break just one.
    closed = text.rlike(f"[{FOREIGN}]") & script.isin("iast", "mixed") & (boundary_mode(text) == "single")
    # A letter stands in a pāda, where a digit may be a verse's number.
    faulty = reduce(Column.__or__, flags.values()) | ((script == "iast") & text.rlike(f"[{FOREIGN}&&[^0-9]]"))
    dealt = lambda rows: rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("verse_id"))
    judged = _judged(analyses(dealt(verses.where(~closed & ~faulty)), spelled=False)).select("verse_id", "unread", "pattern", "matras", (F.size("faults") + F.col("disordered").cast("int")).alias("faults"))
    counted = analyses(dealt(verses.where(~closed & faulty)), spelled=False).select("verse_id", "unread", "pattern", "matras", F.lit(0).alias("faults"))
    unread = verses.where(closed).select("verse_id", F.lit("unknown-character").alias("unread"), F.lit("").alias("pattern"), F.lit(0).alias("matras"), F.lit(0).alias("faults"))
    analysis = judged.unionByName(counted).unionByName(unread)
    heavy = F.char_length(F.translate("pattern", "L", ""))
    per_verse = analysis.groupBy("verse_id").agg(F.count("*").alias("padas"), F.sum(F.char_length("pattern")).alias("syllables"), F.sum(F.char_length("pattern") - heavy).alias("laghu"), F.sum(heavy).alias("guru"), F.sum("matras").alias("matras"), F.array_sort(F.collect_set("unread")).alias("unread"), F.sum("faults").alias("faults"))
    errors = F.array_compact(F.array(*[F.when(bad, name) for name, bad in flags.items()]))
    rows = verses.select("verse_id", script.alias("script"), errors.alias("errors")).join(per_verse, "verse_id", "left")
    rows = rows.withColumn("errors", F.concat("errors", F.coalesce("unread", F.array().cast("array<string>"))))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("padas", "syllables", "laghu", "guru", "matras")]
    status = F.when((F.size("errors") > 0) | (F.coalesce("syllables", F.lit(0)) == 0), "not-run").when(F.col("faults") > 0, "failed").otherwise("verified")
    return rows.select("verse_id", "script", *counts, "errors", status.alias("status"), (status == "verified").alias("ok"))


def annotated(analysis: DataFrame) -> DataFrame:
    """verse_id, pada_index and words of each pāda that was read: of each word its pieces (text, weight, anceps).

    A word is cut where a syllable begins inside it, after a letter at least, so its pieces give exactly the word; a
    piece has the weight of the syllable whose vowel stands in it, and none where only consonants do. Syllables and
    words meet by their places in the source, in the row.
    """
    # Exploded, as a filter on the syllables themselves is derived down to where they are made, and makes them all again.
    held = F.when(F.col("unread").isNull() & (F.size("syllables") > 0), F.array("syllables"))
    rows = analysis.select("verse_id", "pada_index", "source", F.explode_outer(held).alias("syllables")).where("syllables is not null")
    begin, end = F.get("syllables", F.lit(0))["start"], F.element_at("syllables", -1)["end"]
    line = F.substr(F.col("source"), begin + 1, end - begin)
    # A word's blanks before it travel with it, so that lengths add up to places.
    spaced = F.regexp_extract_all(line, F.lit(r"(\s*\S+)"), F.lit(1))
    rows = rows.withColumn("spaced", spaced).withColumn("sizes", F.transform("spaced", F.char_length)).withColumn("ends", P.prefix_sums(F.col("sizes"))).withColumn("begin", begin)
    vowel = lambda s: s["start"] + F.char_length(F.regexp_extract(F.lower(s["source"]), "^([^aāiīuūṛṝḷḹeoअ-औ]*)", 1))
    rows = rows.withColumn("marks", F.transform("syllables", lambda s: F.struct(s["start"].alias("start"), vowel(s).alias("vowel"), F.when(s["weight"] == "guru", "G").otherwise("L").alias("weight"), s["anceps"].alias("anceps"))))

    def word(x: Column) -> Column:
        text = F.regexp_replace(x["spaced"], r"^\s+", "")
        to = F.col("begin") + x["end"]
        start = to - F.char_length(text)
        cuts = F.filter("marks", lambda m: (m["start"] > start) & (m["start"] < to) & F.substr(text, F.lit(1), m["start"] - start).rlike(r"\p{L}"))
        begins = F.concat(F.array(start), F.transform(cuts, lambda m: m["start"]))
        bounds = F.arrays_zip(begins.alias("a"), F.concat(F.slice(begins, F.lit(2), F.greatest(F.size(begins), F.lit(1))), F.array(to)).alias("b"))

        def piece(b: Column) -> Column:
            held = F.get(F.filter("marks", lambda m: (m["vowel"] >= b["a"]) & (m["vowel"] < b["b"])), F.lit(0))
            return F.struct(F.substr(F.col("source"), b["a"] + 1, b["b"] - b["a"]).alias("text"), held["weight"].alias("weight"), F.coalesce(held["anceps"], F.lit(False)).alias("anceps"))

        return F.struct(text.alias("word"), F.transform(F.filter(bounds, lambda b: b["a"].isNotNull() & b["b"].isNotNull()), piece).alias("pieces"))

    return rows.select("verse_id", "pada_index", F.transform(F.arrays_zip(F.col("spaced").alias("spaced"), F.col("ends").alias("end")), word).alias("words"))
