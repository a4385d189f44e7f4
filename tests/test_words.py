"""Queries on single words share their work out over tasks, and make a word's syllables once."""

from kavyamill.operators import syllables as S
from kavyamill.plans import registry


def test_words_are_dealt_by_number(spark, sf):
    words = registry.words(spark, sf)
    assert words.rdd.getNumPartitions() == 4  # one, where the adaptive plan joined them
    assert words.count() == words.distinct().count() > 0


def test_no_filter_makes_the_syllables_again(spark):
    verses = spark.createDataFrame([("a", "vande mātaram"), ("b", "x"), ("c", None)], "verse_id string, text string")
    found = S.annotated(S.analyses(verses))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if line.lstrip(" +-:").startswith("Filter") and "transform(" in line]
    assert [(r.verse_id, [w.word for w in r.words]) for r in found.collect()] == [("a", ["vande", "mātaram"])]
