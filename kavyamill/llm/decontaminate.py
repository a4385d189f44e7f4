"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, windows of five template words are hash-joined with the
benchmark's, and the alignment is checked: enough of the item's windows, and one value for each slot value. Texts are
read in three ways, as names can't be told for sure. A screen goes before: a document that holds an item, in whichever
reading, holds one of the item's anchors, runs of plain words and numbers in any letter case (anchors()).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kavyamill.llm.common import checkpointed

SHINGLE, CONTAINMENT = 5, 0.8
#: Benchmark windows up to which they are looked up in each task's memory; beyond, they are joined by a shuffle.
MAX_LOOKUP = 50_000

#: Units that may follow a number, and private characters that mark names and units.
UNITS = ("km", "m", "cm", "mm", "kg", "g", "mg", "lb", "oz", "mi", "ft", "in", "l", "ml", "s", "sec", "min", "h", "hr", "hours", "days", "years", "%", "°c", "°f", "kw", "kwh", "w", "v", "hz", "mph", "dollars", "euros", "cents")
NAME, UNIT, NUMBER = "\ue000", "\ue002", "\ue001"

# A name is one capitalised word after a word or comma: whole names would swallow a sentence's first word where a
# passage is quoted inside another. The patterns begin with a plain character, which is what most places fail at.
_NAMES = r"(\s)(?<=[\p{Ll}\p{N},;:]\s)(\p{Lu}\p{Ll}+)(?!\p{L})"
_UNITS = rf"(?i)(\d)\s?({'|'.join(sorted(UNITS, key=len, reverse=True))})(?!\p{{L}})"
_TOKEN = rf"{NAME}\p{{Lu}}\p{{Ll}}+|{UNIT}[\p{{L}}%°]+|\d+(?:[.,:/]\d+)*|\p{{L}}+"

# The reading by runs takes each capitalised word as a name, wherever it stands, and words in a row as one name: for names
# that begin a sentence, of several words, of mixed case or in capitals.
_WORD = r"\p{Lu}\p{L}*(?:['’-]\p{Lu}\p{L}*)*"
_RUN = rf"{_WORD}(?:\h+{_WORD})*"
_RUNS = rf"(?<![\p{{L}}{UNIT}]){_RUN}"
_RUN_TOKEN = rf"{NAME}{_RUN}|{UNIT}[\p{{L}}%°]+|\d+(?:[.,:/]\d+)*|\p{{L}}+"


#: The readings of a text: names by what stands before them, every capitalised run a name, no names and one letter case.
READINGS = ("names", "runs", "plain")


def _cleaned(text: Column) -> Column:
    """Without the marks of this module, and without the capital whose lower case is two characters."""
    for x in (NAME, UNIT, NUMBER):
        text = F.replace(text, F.lit(x), F.lit(" "))
    return F.replace(text, F.lit("İ"), F.lit("I"))


def _lower(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit("ς"), F.lit("σ"))


def tokens(text: Column, reading: str = "names") -> Column:
    """Words, numbers, names and units in their order, names and units marked."""
    text = _cleaned(text)
    if reading == "names":
        text = F.regexp_replace(text, _NAMES, f"$1{NAME}$2")
    marked = F.regexp_replace(_lower(text) if reading == "plain" else text, _UNITS, f"$1 {UNIT}$2")
    if reading == "runs":
        marked = F.regexp_replace(marked, _RUNS, f"{NAME}$0")
    return F.regexp_extract_all(F.coalesce(marked, F.lit("")), F.lit(_RUN_TOKEN if reading == "runs" else _TOKEN), F.lit(0))


def typed(raw: Column) -> Column:
    """The template: each token in lower case, or the placeholder of its type."""
    first = lambda x: F.substring(x, 1, 1)
    return F.transform(raw, lambda x: F.when(first(x).isin(NAME, UNIT), first(x)).when(first(x).between("0", "9"), F.lit(NUMBER)).otherwise(_lower(x)))


def _hash_at(template: Column, at: Column, length: int = SHINGLE) -> Column:
    return F.xxhash64(F.slice(template, at + 1, length))


def _windows(template: Column) -> Column:
    """Hashes of the windows; empty below five words."""
    last = F.size(template) - SHINGLE
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: _hash_at(template, i))).otherwise(F.array().cast("array<bigint>"))


def sure_step(n_windows: int) -> int:
    """A step at which some window of a document is met by an item of n windows, if it holds CONTAINMENT of them.

    At most m = n - ceil(CONTAINMENT n) windows are missing. A change inside costs four or more of them, so what is
    left is in at most m // 4 + 1 runs, the longest of which has that many windows on average or more.
    """
    missing = n_windows - -(-int(CONTAINMENT * 1000) * n_windows // 1000)
    return max(1, -(-(n_windows - missing) // (missing // (SHINGLE - 1) + 1)))


def plain_words(text: Column) -> Column:
    """Words and numbers in lower case: what a template has but for names and units, whichever the reading."""
    numbered = F.regexp_replace(_lower(_cleaned(text)), r"\d+(?:[.,:/]\d+)*", f" {NUMBER} ")
    return F.split(F.coalesce(numbered, F.lit("")), rf"[^\p{{L}}{NUMBER}]+")


def _runs(template: Column, starts: Column, length: int) -> Column:
    return F.transform(starts, lambda i: F.slice(template, i + 1, length))


def anchors(template: Column) -> Column:
    """Runs of plain tokens, as many as make sure that a document with the item holds one; null where there aren't enough.

    Of n distinct windows, at most m = n - ceil(CONTAINMENT n) are missing. A run of L tokens is only lost with the window
    that begins where it does, or, for the last SHINGLE - L of them, at the end. So of m + SHINGLE - L + 1 distinct runs
    one is there. The longest L with so many runs is taken, and the runs that begin with the longest words, the rarest ones.
    """
    n = F.size(F.array_distinct(_windows(template)))
    missing = n - F.ceil(n * F.lit(round(CONTAINMENT * 1000)) / 1000)
    found = F.lit(None).cast("array<array<string>>")
    for length in range(2, SHINGLE + 1):
        starts = F.when(F.size(template) >= length, F.sequence(F.lit(0), F.size(template) - length)).otherwise(F.array().cast("array<int>"))
        plain = F.filter(_runs(template, starts, length), lambda g: ~F.exists(g, lambda x: x.isin(NAME, UNIT)))
        need = missing + SHINGLE - length + 1
        ranked = F.sort_array(F.transform(F.array_distinct(plain), lambda g: F.struct(F.length(F.get(g, F.lit(0))).alias("n"), g.alias("g"))), asc=False)
        chosen = F.transform(F.slice(ranked, F.lit(1), need.cast("int")), lambda x: x["g"])
        found = F.when(F.size(ranked) >= need, chosen).otherwise(found)
    return found


def _screened(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """(row, doc_id, text) of the documents that hold one of the runs (anchor: array of words)."""
    rows = docs.select("doc_id", "text", plain_words(F.col("text")).alias("words"))
    runs = checkpointed(runs.select(F.size("anchor").alias("length"), F.get("anchor", F.lit(0)).alias("word"), F.xxhash64("anchor").alias("h")).distinct())
    lengths = [n for (n,) in runs.select("length").distinct().collect()]  # at most four
    if runs.count() <= MAX_LOOKUP:
        wanted = {n: ([], []) for n in lengths}
        for n, word, h in runs.collect():  # bounded by MAX_LOOKUP
            wanted[n][0].append(word)
            wanted[n][1].append(h)
        first = sorted({x for words, _ in wanted.values() for x in words})
        here = lambda x, i: x.isin(first) & reduce(or_, (x.isin(sorted(set(words))) & _hash_at(F.col("words"), i, n).isin(hashes) for n, (words, hashes) in sorted(wanted.items())))
        held = F.slice(F.filter("words", here), 1, 1)
        # No filter on what is computed: pushed below, it would compute it twice.
        rows = rows.select("doc_id", "text", F.explode_outer(held).alias("at")).where("at is not null").select("doc_id", "text")
    else:
        hashes = F.concat(*(F.transform(_runs(F.col("words"), F.sequence(F.lit(0), F.size("words") - 1), n), lambda g: F.xxhash64(g)) for n in lengths))
        keyed = docs.select("doc_id", plain_words(F.col("text")).alias("words")).select("doc_id", F.explode_outer(F.array_distinct(hashes)).alias("h"))
        rows = docs.select("doc_id", "text").join(keyed.join(runs.select("h").distinct(), "h", "left_semi").select("doc_id").distinct(), "doc_id", "left_semi")
    return checkpointed(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, containment, consistent, changed and leak for each document and item that share enough.

    containment is the share of the item's distinct five-word template windows near one place of the document; rows
    have CONTAINMENT or more under one of the three readings. consistent: along the alignment, equal slot values
    of the item have equal values in the document. changed: some value differs, letter case aside. leak: consistent. The
    best row of a document and item is kept. Rows with the same doc_id count as one document, rows with the same item_id
    as items of one name; repeated rows change nothing. Null and empty texts, texts and items below five words share
    nothing, ever. Texts of any length are read whole. Other columns are ignored.
    """
    docs, pairs = docs.select("doc_id", "text"), []
    items = {x: _items(benchmark, x) for x in READINGS}
    every = reduce(DataFrame.unionByName, (x.select("anchors") for x in items.values()))
    runs = every.select(F.explode("anchors").alias("anchor"))
    screened = _screened(docs, runs) if runs.take(1) else None
    for reading, of in items.items():
        sure, unsure = of.where("anchors is not null"), of.where("anchors is null")
        if screened is not None:
            pairs.append(_aligned(screened, sure, reading))
        if unsure.take(1):  # items almost without plain words: all documents are looked at
            pairs.append(_aligned(docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text"), unsure, reading))
    pairs = [x for x in pairs if x is not None]
    if not pairs:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, containment double, consistent boolean, changed boolean, leak boolean")
    best = reduce(DataFrame.unionByName, pairs).groupBy("doc_id", "item_id").agg(F.max(F.struct("consistent", "containment", (~F.col("changed")).alias("unchanged"))).alias("best"))
    return best.select("doc_id", "item_id", "best.containment", "best.consistent", (~F.col("best.unchanged")).alias("changed"), F.col("best.consistent").alias("leak"))


def _items(benchmark: DataFrame, reading: str) -> DataFrame:
    items = benchmark.select("item_id", tokens(F.col("text"), reading).alias("item_raw")).distinct().withColumn("item", typed(F.col("item_raw"))).where(F.size("item") >= SHINGLE)
    return checkpointed(items.select("item_id", "item_raw", "item", F.array_distinct(_windows(F.col("item"))).alias("item_windows"), anchors(F.col("item")).alias("anchors"), F.xxhash64("item_id", "item_raw").alias("item_key")))


def _aligned(docs: DataFrame, items: DataFrame, reading: str) -> DataFrame | None:
    """doc_id, item_id, containment, consistent and changed of each place of docs (row, doc_id, text); None without items."""
    total = items.agg(F.sum(F.size("item"))).first()[0]
    if not total:
        return None
    step = min(sure_step(n) for (n,) in items.select(F.size("item_windows")).distinct().collect())
    keys = items.select("item_key", F.size("item").alias("length"), F.posexplode(_windows(F.col("item"))).alias("item_at", "h"))
    cut = docs.select("row", tokens(F.col("text"), reading).alias("raw")).select("row", typed(F.col("raw")).alias("template"))
    last = F.size("template") - SHINGLE
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step)))
    if total <= MAX_LOOKUP:
        wanted = [h for (h,) in keys.select("h").distinct().collect()]  # bounded by MAX_LOOKUP
        starts = F.filter(starts, lambda i: _hash_at(F.col("template"), i).isin(wanted))
        keys, items = F.broadcast(keys), F.broadcast(items)
    met = F.transform(starts, lambda i: F.struct(i.alias("at"), _hash_at(F.col("template"), i).alias("h")))
    hits = cut.select("row", F.explode_outer(met).alias("x")).where("x.h is not null").select("row", "x.*").join(keys, "h")
    # Hashes are joined first; only then the places are cut out, each to the length of its item.
    hits = hits.select("row", "item_key", (F.col("at") - F.col("item_at")).alias("from")).distinct()
    raws = docs.select("row", "doc_id", tokens(F.col("text"), reading).alias("raw"))
    pairs = hits.join(raws, "row").join(items, "item_key")
    slack = F.floor(F.size("item") / 4).cast("int") + SHINGLE
    begin = F.greatest(F.col("from") - slack, F.lit(0))
    pairs = pairs.select("doc_id", "item_id", "item_raw", "item", "item_windows", (F.col("from") - begin).alias("shift"), F.slice("raw", begin + 1, F.size("item") + 2 * slack).alias("raw"))
    pairs = pairs.withColumn("near", typed(F.col("raw"))).withColumn("containment", F.size(F.array_intersect("item_windows", _windows(F.col("near")))) / F.size("item_windows"))
    pairs = pairs.where(F.col("containment") >= CONTAINMENT)
    slots = F.transform("item_raw", lambda x, j: F.struct(_lower(x).alias("a"), _lower(F.when(F.col("shift") + j >= 0, F.get("raw", F.col("shift") + j))).alias("b"), F.get("item", j).alias("kind")))
    same_kind = F.filter(slots, lambda s: s["kind"].isin(NAME, UNIT, NUMBER) & (F.get(typed(F.array(s["b"])), F.lit(0)) == s["kind"]))
    values = F.array_distinct(F.transform(same_kind, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"))))
    pairs = pairs.withColumn("slots", values)
    one = F.size(F.array_distinct(F.transform("slots", lambda s: s["a"]))) == F.size("slots")
    return pairs.select("doc_id", "item_id", "containment", one.alias("consistent"), F.exists("slots", lambda s: s["a"] != s["b"]).alias("changed"))
