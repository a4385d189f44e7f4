"""Spelling variants: words at distance one meet by symmetric deletes, and point to the more frequent form.

Every word emits the hash of itself and of each of its distinct single deletions, with the run of equal letters that
the deleted one stands in. Two words are at distance one if one of them is a deletion of the other, or if both have
the same deletion at the same place; so an equi-join on the hash, with the places, finds each pair once. The words
themselves stay where they are until a pair is found, so that a very long word costs its length and not its square;
then they are fetched by their hashes and compared letter by letter. Forms are followed to roots by pointer doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kavyamill.llm.common import checkpointed, in_arrow, mix

#: The letters of a run; of these only A-Z are lower-cased.
LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a letter.
DAMAGE = 97
#: Letters that the numpy kernel works on at once; a longer word makes a block of its own.
BLOCK = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)


def damaged(doc_id: Column, run: Column) -> Column:
    """The run, or the run without one letter where DAMAGE divides the checksum of "doc_id:run"; a null doc_id deletes none."""
    h = F.crc32(F.concat(doc_id, F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % DAMAGE == 0, F.concat(F.left(run, at), F.substr(run, at + 2))).otherwise(run)


def vocabulary(docs: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n): words of at least `shortest` letters that occur at least `least` times in all texts.

    Counts are summed in each task before they are shuffled, so a very frequent word costs no more than another.
    """
    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.split(F.translate("text", UPPER, LOWER), f"[^{LETTERS}]+")).alias("run"))
    words = found.where(F.char_length("run") >= shortest).select(damaged(F.col("doc_id"), F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _powers(n: int) -> np.ndarray:
    steps = np.full(n, _BASE)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def deletions(words: list[str]) -> tuple[np.ndarray, ...]:
    """word, key, first, last for each word (first and last -1) and each of its distinct single deletions: the hash of
    what is left, and the run of equal letters that the deleted one is in. Letters of a block are hashed together, by
    prefix sums, so a deletion costs the same whatever the word's length."""
    size = np.array([len(w) for w in words])
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    start = np.cumsum(size) - size
    of = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(letters)) - start[of]
    up = _powers(int(size.max(initial=0)) + 1)
    # A letter at place i weighs BASE^i; behind a deletion, where it has moved to i - 1, BASE^(i - 1).
    stays, moved = np.zeros((2, len(letters) + 1), np.uint64)
    np.cumsum(letters * up[place], out=stays[1:])
    np.cumsum(np.where(place > 0, letters * up[np.maximum(place - 1, 0)], np.uint64(0)), out=moved[1:])
    end = start + size
    first = np.flatnonzero((place == 0) | (letters != np.roll(letters, 1)))
    last = np.concatenate([first[1:], [len(letters)]]) - 1 if len(first) else first
    owner = of[first]
    left = stays[first] - stays[start[owner]] + moved[end[owner]] - moved[first + 1]
    whole = stays[end] - stays[start]
    key = mix(np.concatenate([whole + size.astype(np.uint64), left + (size[owner] - 1).astype(np.uint64)]))
    none = np.full(len(words), -1)
    return np.concatenate([np.arange(len(words)), owner]), key, np.concatenate([none, place[first]]), np.concatenate([none, place[last]])


def keys(words: DataFrame) -> DataFrame:
    """(key, id, first, last) of every word and each of its single deletions; id is the word's own hash."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held = batch.column("id").to_numpy(), batch.column("word").to_pylist()
            at, letters = 0, 0
            for i, w in enumerate(held, 1):
                letters += len(w)
                if letters >= BLOCK or i == len(held):
                    of, key, first, last = deletions(held[at:i])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[at:i][of]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], schema=schema)
                    at, letters = i, 0

    return in_arrow(words.select("id", "word"), run, "key long, id long, first int, last int")


def at_distance_one(a: Column, b: Column, place: Column) -> Column:
    """Whether a and b, letter by letter, differ in the letter at `place` alone, or b is a without that letter."""
    same_head = F.left(a, place) == F.left(b, place)
    return same_head & F.when(F.char_length(a) == F.char_length(b), (F.substr(a, place + 2) == F.substr(b, place + 2)) & (a != b)).otherwise((F.char_length(a) == F.char_length(b) + 1) & (F.substr(a, place + 2) == F.substr(b, place + 1)))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n) for each unordered pair of (word, n) at distance one, once: one letter inserted, deleted or
    replaced. A swap of neighbours is not one. Words are distinct and not null.

    The words that share a key with one deletion differ from each other in one inserted letter, so a key's group is
    bounded by the alphabet and the word's length, however frequent the words are.
    """
    named = words.select(F.xxhash64("word").alias("id"), "word", "n")
    k = keys(named)
    other = k.select(F.col("key").alias("key"), F.col("id").alias("id_b"), F.col("first").alias("first_b"), F.col("last").alias("last_b"))
    replaced = (F.col("id") < F.col("id_b")) & (F.col("first_b") >= 0) & (F.greatest("first", "first_b") == F.least("last", "last_b"))
    shortened = (F.col("first_b") < 0) & (F.col("id") != F.col("id_b"))
    found = k.where("first >= 0").join(other, "key").where(replaced | shortened)
    found = found.select("id", "id_b", F.greatest("first", "first_b").alias("place"))
    with_a = found.join(named.select("id", F.col("word").alias("a"), F.col("n").alias("a_n")), "id")
    both = with_a.join(named.select(F.col("id").alias("id_b"), F.col("word").alias("b"), F.col("n").alias("b_n")), "id_b")
    return both.where(at_distance_one(F.col("a"), F.col("b"), F.col("place"))).select("a", "a_n", "b", "b_n")


def forms(words: DataFrame, factor: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word: how many words are at distance one, and the most frequent of
    them (of equally frequent ones the first in code-point order) if it is at least `factor` times as frequent."""
    pairs = near_pairs(words)
    sides = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = sides.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    rows = words.join(best, "word", "left").withColumn("frequent", -F.col("best.less") >= factor * F.col("n"))
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("frequent"), F.col("best.form")).alias("form"), F.when(F.col("frequent"), -F.col("best.less")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for each word of (word, form): where its forms end. Each round joins what is pointed at with what
    that points at, so rounds grow with the logarithm of the longest chain, and forms, which are ever more frequent,
    make no circle. One number a round reaches the driver."""
    at = checkpointed(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = at.join(ahead, "root", "left")
        at = checkpointed(moved.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame, shortest: int = 5, least: int = 3, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts (see vocabulary() and forms()).

    Null and empty texts have no words; rows that repeat, with their doc_ids, count as often as they come; other columns
    are ignored. A text is read whole, whatever its length.
    """
    words = checkpointed(vocabulary(docs, shortest, least))
    found = checkpointed(forms(words, factor))
    led = roots(found.where("form is not null").select("word", "form"))
    return found.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
