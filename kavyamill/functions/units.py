"""Digits in verse text, other letter schemes, unit labels, and durations spread over smaller units, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kavyamill.functions.text import DEVA_SIGNS, DEVA_VOWELS, SCRIPTS, VIRAMA, iast_to_deva, script_by_share, script_of

# Roman vowels a protracted digit may follow; ITRANS letters and their roman forms; labels of units.
PLUTA_VOWELS = "aāiīuūṛṝḷḹeo"
ITRANS = (("kSh", "kṣ"), ("GY", "jñ"), ("dny", "jñ"), ("RRI", "ṝ"), ("R^I", "ṝ"), ("RRi", "ṛ"), ("R^i", "ṛ"), ("LLI", "ḹ"), ("LLi", "ḷ"), ("~N", "ṅ"), ("N^", "ṅ"), ("~n", "ñ"), ("JN", "ñ"), ("chh", "\ue003"), ("Ch", "\ue003"), ("ch", "\ue004"), ("shh", "ṣ"), ("Sh", "ṣ"), ("sh", "ś"), ("Th", "ṭh"), ("Dh", "ḍh"), ("T", "ṭ"), ("D", "ḍ"), ("N", "ṇ"), ("aa", "ā"), ("ii", "ī"), ("ee", "ī"), ("uu", "ū"), ("oo", "ū"), ("A", "ā"), ("I", "ī"), ("U", "ū"), (".n", "ṃ"), ("M", "ṃ"), ("H", "ḥ"), ("w", "v"), (".a", "'"), ("\ue003", "ch"), ("\ue004", "c"))
ANUSTUBH, TRISTUBH = "anuṣṭubh (śloka)", "triṣṭubh / upajāti"

_DIGIT = "0-9०-९"
_DEVA_SITE = "[" + "".join(DEVA_VOWELS) + "".join(DEVA_SIGNS) + "ऄक-ह\\x{0958}-\\x{095F}]"
_OFFSETS = {"devanagari": 0x0900, "bengali": 0x0980, "gurmukhi": 0x0A00, "gujarati": 0x0A80, "oriya": 0x0B00, "tamil": 0x0B80, "telugu": 0x0C00, "kannada": 0x0C80, "malayalam": 0x0D00}


def fricative_onset(slp1: Column) -> Column:
    """Whether the first sound is ś, ṣ, s or h; null for null, false for an empty text."""
    return F.substring(slp1, 1, 1).isin("S", "z", "s", "h")


def digit_kinds(text: Column) -> Column:
    """Kind of each digit in order: pluta (a 3 after a vowel or, in Devanagari, a consonant with its own vowel), verse
    number (in a run between a danda and nothing but dandas) or invalid."""
    deva = text.rlike("[ऀ-ॿ]")

    def kind(digit: Column, place: Column) -> Column:
        before, after = F.substr(text, F.lit(1), place), F.substr(text, place + 2)
        site = F.when(deva, before.rlike(_DEVA_SITE + "$")).otherwise(F.lower(before).rlike(f"[{PLUTA_VOWELS}]$"))
        number = F.regexp_replace(before, f"[{_DIGIT}]+$", "").rlike(r"[।॥|]\s*$") & F.regexp_replace(after, f"^[{_DIGIT}]+", "").rlike(r"^\s*[।॥|]*\s*$")
        return F.when(digit.isin("3", "३") & site, "pluta").when(number, "verse-number").otherwise("invalid")

    places = F.filter(F.transform(F.split(text, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: x["c"].rlike(f"^[{_DIGIT}]$"))
    return F.transform(places, lambda x: kind(x["c"], x["i"]))


def itrans_to_iast(text: Column) -> Column:
    for a, b in ITRANS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def to_devanagari(text: Column) -> Column:
    """Devanagari as it is; roman with diacritics by its letters; anything else read as ITRANS."""
    script = script_by_share(text)
    return F.when(script == "devanagari", text).when(script == "iast", iast_to_deva(text)).otherwise(iast_to_deva(itrans_to_iast(text)))


def displayed(text: Column, target: str) -> Column:
    """Devanagari text in the script `target` (one of SCRIPTS but grantha): blocks share their layout. Devanagari and
    unknown names leave it as it is; the dandas and what has no counterpart stay."""
    if target not in dict(SCRIPTS) or target in ("devanagari", "grantha"):
        return text
    letters = [chr(0x0900 + i) for i in range(0x70) if i not in (0x64, 0x65)]
    return F.translate(text, "".join(letters), "".join(chr(_OFFSETS[target] + ord(c) - 0x0900) for c in letters))


def in_devanagari(text: Column) -> Column:
    """Text of any of SCRIPTS but grantha in Devanagari, by the block of its first Brahmic letter; others stay as they are."""
    script = script_of(text)
    letters = [chr(0x0900 + i) for i in range(0x70) if i not in (0x64, 0x65)]
    out = text
    for name, offset in _OFFSETS.items():
        if name != "devanagari":
            out = F.when(script == name, F.translate(text, "".join(chr(offset + ord(c) - 0x0900) for c in letters), "".join(letters))).otherwise(out)
    return out


def studio_lines(text: Column) -> Column:
    """Lines of an input: roman letters become Devanagari, newlines and dandas part, numbers and brackets go."""
    deva = F.when(text.rlike("[a-zA-Z]"), iast_to_deva(text)).otherwise(F.trim(text))
    parts = F.split(deva, r"[\n।॥|]")
    return F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"[0-9०-९.()\[\]]+", ""))), lambda x: x != "")


def unit_label(name: Column, syllables: Column) -> Column:
    """Name of a unit by the conventions of recitation: counts of a śloka and of a triṣṭubh give the name where the
    detector has none, or one that such a count makes unlikely; other counts without a name are labelled by number."""
    none = F.coalesce(name, F.lit("")) == ""
    sloka = syllables.isin(8, 16, 32) & (none | name.isin("kanyā", "unknown", "unidentified"))
    tristubh = syllables.isin(11, 22, 23, 44, 45) & (none | name.startswith("nicṛt gāyatrī"))
    return F.when(sloka, ANUSTUBH).when(tristubh, TRISTUBH).when(none & ~syllables.isin(8, 16, 32, 11, 22, 23, 44, 45), F.concat(F.lit("chandas ("), syllables.cast("string"), F.lit(" akṣaras)"))).otherwise(name)


def first_known(*names: Column) -> Column:
    """The first of several detectors' answers that is neither null nor empty, else ''."""
    return F.coalesce(*[F.when(x != "", x) for x in names], F.lit(""))


def duration_budget(reference: Column, syllables: Column, seconds: Column) -> Column:
    """Length of the reference and of the syllables to come; null where the seconds a syllable aren't above 0."""
    return F.when(seconds > 0, reference + syllables * seconds)


def exact_sum(values: Column) -> Column:
    """Sum of a group's doubles that does not depend on their order: exact where each is a decimal number of at most 12
    places and 18 digits before them, then rounded once; else, and for an infinite one, the sum of doubles."""
    exact = values.try_cast("decimal(30,12)")
    return F.when(F.bool_and(values.isNull() | exact.cast("double").eqNullSafe(values)), F.try_sum(exact).cast("double")).otherwise(F.sum(values))


def fitted(values: Column, size: Column, fill: float = 2.0) -> Column:
    """The first `size` values, or all of them and as many of `fill` as are missing."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill), F.greatest(size - F.size(values), F.lit(0)))), F.lit(1), size)


def spread(durations: Column, sizes: Column) -> Column:
    """Each duration shared out evenly over so many parts, no part below 1; parts of size 0 take theirs along."""
    return F.flatten(F.zip_with(durations, sizes, lambda d, n: F.array_repeat(F.greatest(d, n.cast("double")) / F.greatest(n, F.lit(1)), n)))


def map_put(m: Column, key: Column, value: Column) -> Column:
    return F.map_concat(map_delete(m, key), F.create_map(key, value))


def map_delete(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda k, v: k != key)


def deva_clusters_match(parts: Column, deva: Column) -> Column:
    """Roman syllables paired with as many written ones of Devanagari, null where their numbers differ."""
    clusters = F.filter(F.split(deva, rf"(?<!^)(?<!{VIRAMA})(?=[अ-औक-ह])"), lambda x: F.trim(x) != "")
    return F.when(F.size(parts) == F.size(clusters), F.arrays_zip(parts.alias("roman"), clusters.alias("deva")))
