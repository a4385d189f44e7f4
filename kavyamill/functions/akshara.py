"""One written syllable judged by itself: is it one, what are its parts, how heavy is it, and by which rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kavyamill.functions import prosody as P
from kavyamill.functions import text as X

# The rules by which a syllable is weighed, and where they stand.
RULES = {
    "pluta-guru": "Pāṇini 1.2.27",
    "dirgha-guru": "CS 1.12 · Pāṇini 1.4.12",
    "mark-guru": "CS 1.11 · VR 1.9",
    "closed-guru": "CS 1.11 · Pāṇini 1.4.11",
    "position-guru": "CS 1.11 · Pāṇini 1.4.11",
    "hrasva-laghu": "CS 1.9 · Pāṇini 1.4.10",
}
_CONSONANT = f"[^{P.VOWELS}MH]"


def _sounds(text: Column) -> Column:
    """One character a sound, of Devanagari or roman text; what can't be read becomes '?'."""
    roman = F.regexp_replace(F.regexp_replace(F.lower(text), "[fqwxz]", "?"), r"[^\p{L}\p{M}?\s’'-]", "?")
    return F.when(text.rlike("[ऀ-ॿ]"), P.letters(X.deva_to_slp1(text))).otherwise(P.canonical_iast(roman))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def judge(text: Column, following: Column | None = None, pada_final: Column | None = None) -> Column:
    """(valid, reason, onset, vowel, mark, coda, weight, matras, rule, authority, position_sensitive, anceps, pluta).

    A syllable has any consonants, one vowel, perhaps one mark right after it, perhaps closing consonants. A 3 right
    after the vowel makes it three mātrās long. reason names the first fault of one that isn't a syllable: empty, break,
    mixed-script, several-plutas, unknown-character, mark-alone, no-vowel, several-vowels, mark-first, mark-apart or
    pluta-apart; all else is null then, and the whole is for null text. `following` is the text after it, across blanks
    but not across a danda: two consonants there make a short open syllable heavy; where it is null, that is left open
    as position_sensitive. A syllable that ends a pāda counts as either.
    """
    following = F.lit(None).cast("string") if following is None else following
    bare = F.regexp_replace(F.trim(text), "[’'ऽ]", "")
    opening = F.length(F.regexp_extract(_sounds(F.regexp_replace(following, r"(?s)[|।॥\n].*$", "")), f"^([^{P.VOWELS}MH?]*)", 1))

    def heard(b: Column) -> Column:
        return F.struct(b.alias("bare"), F.length(F.regexp_replace(b, "[^3३]", "")).alias("digits"), _sounds(F.regexp_replace(b, "[3३]", "")).alias("s"), _sounds(F.regexp_replace(b, "[3३].*$", "")).alias("to_digit"), opening.alias("opening"))

    def faulted(x: Column) -> Column:
        vowels = F.length(F.regexp_replace(x["s"], f"[^{P.VOWELS}]", ""))
        reason = (
            F.when(x["bare"] == "", "empty")
            .when(x["bare"].rlike(r"[\s\-|।॥]"), "break")
            .when(x["bare"].rlike("[ऀ-ॿ]") & x["bare"].rlike(r"\p{IsLatin}"), "mixed-script")
            .when(x["digits"] > 1, "several-plutas")
            .when(P.unknown_characters(x["s"]) != "", "unknown-character")
            .when((vowels == 0) & x["s"].rlike("[MH]"), "mark-alone")
            .when(vowels == 0, "no-vowel")
            .when(vowels > 1, "several-vowels")
            .when(x["s"].rlike(f"^{_CONSONANT}*[MH]"), "mark-first")
            .when(x["s"].rlike(f"[^{P.VOWELS}][MH]"), "mark-apart")
            .when((x["digits"] == 1) & ~x["to_digit"].rlike(f"^{_CONSONANT}*[{P.VOWELS}]$"), "pluta-apart")
        )
        part = lambda i: F.regexp_extract(x["s"], f"^({_CONSONANT}*)([{P.VOWELS}])([MH]?)({_CONSONANT}*)$", i)
        return F.struct(reason.alias("reason"), *[part(i).alias(n) for i, n in enumerate(("onset", "vowel", "mark", "coda"), 1)], x["digits"].alias("digits"), x["opening"].alias("opening"))

    def weighed(x: Column) -> Column:
        rule = F.when(x["digits"] == 1, "pluta-guru").when(x["vowel"].isin(*P.LONG), "dirgha-guru").when(x["mark"] != "", "mark-guru").when(x["coda"] != "", "closed-guru").when(x["opening"] >= 2, "position-guru").otherwise("hrasva-laghu")
        return F.struct(x.alias("x"), F.when(x["reason"].isNull(), rule).alias("rule"))

    def told(y: Column) -> Column:
        x, rule = y["x"], y["rule"]
        valid = rule.isNotNull()
        authority = F.element_at(F.create_map(*[F.lit(v) for pair in RULES.items() for v in pair]), rule)
        return F.struct(
            valid.alias("valid"), x["reason"].alias("reason"), *[F.when(valid, x[n]).alias(n) for n in ("onset", "vowel", "mark", "coda")],
            F.when(rule == "hrasva-laghu", "laghu").when(valid, "guru").alias("weight"), F.when(rule == "pluta-guru", 3).when(rule == "hrasva-laghu", 1).when(valid, 2).alias("matras"), rule.alias("rule"), authority.alias("authority"),
            F.when(valid, (rule == "hrasva-laghu") & x["opening"].isNull()).alias("position_sensitive"), F.when(valid, F.lit(False) if pada_final is None else F.coalesce(pada_final, F.lit(False))).alias("anceps"), F.when(valid, x["digits"] == 1).alias("pluta"),
        )

    return F.when(text.isNotNull(), _let(_let(_let(_let(bare, heard), faulted), weighed), told))
