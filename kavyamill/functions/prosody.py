"""Syllables and weights as Column functions.

Each phoneme is one character (SLP1-like), so that a vowel and all up to the next vowel is one regex token, and a
syllable's weight is a function of its token. All of it stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vowels, marks that close a syllable, and how roman letters become one character a phoneme.
SHORT, LONG, MARKS = "aiufx", "AIUFXeEoO", "MH~"
VOWELS = SHORT + LONG
IAST_PAIRS = (("m̐", "M"), ("ai", "E"), ("au", "O"), ("kh", "K"), ("gh", "G"), ("ch", "C"), ("jh", "J"), ("ṭh", "W"), ("ḍh", "Q"), ("th", "T"), ("dh", "D"), ("ph", "P"), ("bh", "B"))
IAST_FROM, IAST_TO = "āīūṛṝḷḹṃṁḥẖḫṅñṭḍṇśṣḻ", "AIUfFxXMMHHHNYwqRSzL"
TRANSPARENT = " \t\n-’'|।॥̐"
ALPHABET = VOWELS + "MH" + "kKgGNcCjJYwWqQRtTdDnpPbBmyrlvSzshL"

TOKEN = f"[{VOWELS}][^{VOWELS}]*"


def canonical_iast(text: Column) -> Column:
    """Roman text, one character a phoneme, transparent characters gone; pairs are merged before. Letters that roman
    Sanskrit lacks become ?, as they stand for other sounds here."""
    return canonical_lower(F.lower(text))


def canonical_lower(lowered: Column) -> Column:
    """canonical_iast() of a text in lower case."""
    out = F.translate(lowered, "fqwxz", "?????")
    for pair, one in IAST_PAIRS:
        out = F.replace(out, F.lit(pair), F.lit(one))
    return F.translate(F.translate(out, IAST_FROM, IAST_TO), TRANSPARENT, "")


def unknown_characters(canonical: Column) -> Column:
    """What canonical_iast() could not read; not empty means that the line can't be scanned."""
    return F.translate(canonical, ALPHABET, "")


def letters(slp1: Column) -> Column:
    """Only letters and candrabindu: blanks, digits, dandas and elision marks go."""
    return F.regexp_replace(slp1, r"[^\p{L}~]", "")


def tokens(clean: Column) -> Column:
    return F.regexp_extract_all(clean, F.lit(f"({TOKEN})"), F.lit(1))


def token_weight(token: Column) -> Column:
    """G for a long vowel, a closing mark or two consonants before the next vowel; else L."""
    after = F.substr(token, F.lit(2))
    heavy = F.substring(token, 1, 1).isin(*LONG) | after.rlike(f"[{MARKS}]") | (F.length(after) >= 2)
    return F.when(heavy, "G").otherwise("L")


def weights(clean: Column, final: str = "natural") -> Column:
    """Weights of a clean string. final: 'natural', or 'guru' to count the last syllable heavy."""
    found = F.transform(tokens(clean), token_weight)
    if final == "guru":
        found = F.when(F.size(found) > 0, F.concat(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), F.array(F.lit("G")))).otherwise(found)
    return found


def pattern(clean: Column, final: str = "natural") -> Column:
    return F.array_join(weights(clean, final), "")


def class_pattern(clean: Column) -> Column:
    """Weights of a clean string by a second way, from the letters' classes: short, long, mark and consonant. A long vowel
    is heavy, a short one before a mark, a consonant and a mark, or two consonants too; each rule is one pass."""
    short, long, mark, other = "\ue000", "\ue001", "\ue002", "\ue003"
    classes = F.translate(F.regexp_replace(clean, f"[^{VOWELS}{MARKS}]", other), VOWELS + MARKS, short * len(SHORT) + long * len(LONG) + mark * len(MARKS))
    rest = f"[{mark}{other}]"
    heavy = F.regexp_replace(F.regexp_replace(classes, f"^{rest}++", ""), f"{long}{rest}*+|{short}(?={other}?{mark}|{other}{other}){rest}*+", "G")
    return F.regexp_replace(heavy, f"{short}{other}?+", "L")


def iast_pattern(text: Column) -> Column:
    """Weights of a roman line: marks and clusters count, a final consonant makes the last syllable heavy if it is
    not the only one, and so does any consonant that ends the line; null if a character is unknown."""
    clean = canonical_iast(text)
    found = tokens(clean)

    def weigh(token: Column, i: Column) -> Column:
        after = F.substr(token, F.lit(2))
        consonants = F.length(F.translate(after, "MH", ""))
        last = i == F.size(found) - 1
        heavy = F.substring(token, 1, 1).isin(*LONG) | after.rlike("[MH]") | (consonants >= 2) | (last & (consonants >= 1))
        return F.when(heavy, "G").otherwise("L")

    return F.when(unknown_characters(clean) == "", F.array_join(F.transform(found, weigh), ""))


def syllable_texts(clean: Column) -> Column:
    """Onset, vowel and marks of each syllable; what follows the last joins it."""
    parts = F.regexp_extract_all(clean, F.lit(f"([^{VOWELS}]*[{VOWELS}][{MARKS}]*)"), F.lit(1))
    rest = F.regexp_extract(clean, f"([^{VOWELS}]*)$", 1)
    tail = F.regexp_replace(rest, f"^[{MARKS}]*", "")
    return F.when(F.size(parts) > 0, F.concat(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.concat(F.element_at(parts, -1), tail)))).otherwise(parts)


def tagged_syllables(slp1: Column) -> Column:
    """Structs (vowel, weight, cause, is_pada_final) of pauses-and-words text: | ends a pāda, blanks don't break
    clusters, a candrabindu after a consonant adds nothing. Causes by precedence: long_vowel, visarga, anusvara,
    cluster, pada_final_anceps, and null for a light syllable."""
    plain = F.translate(slp1, "'~ ", "")
    found = F.regexp_extract_all(plain, F.lit(f"([{VOWELS}][^{VOWELS}]*)"), F.lit(1))

    def tag(token: Column, i: Column) -> Column:
        after = F.substr(token, F.lit(2))
        gap = F.regexp_extract(after, r"^([^|]*)", 1)
        final = F.contains(after, F.lit("|")) | (i == F.size(found) - 1)
        first = F.substring(gap, 1, 1)
        cause = F.when(F.substring(token, 1, 1).isin(*LONG), "long_vowel").when(first == "H", "visarga").when(first == "M", "anusvara").when(F.length(gap) >= 2, "cluster").when(final, "pada_final_anceps")
        return F.struct(F.substring(token, 1, 1).alias("vowel"), F.when(cause.isNotNull(), "G").otherwise("L").alias("weight"), cause.alias("cause"), final.alias("is_pada_final"))

    return F.transform(found, tag)


def matras(weight_pattern: Column) -> Column:
    """Total length: one for a light syllable, two for a heavy one."""
    return F.length(weight_pattern) + F.length(F.translate(weight_pattern, "L", ""))


def template(weight_pattern: Column, yati: Column | None = None) -> Column:
    """Glyphs in threes, a double bar after each caesura, a star at the end."""
    glyphs = F.translate(weight_pattern, "GL", "—◡")
    cuts = F.coalesce(yati, F.array().cast("array<int>")) if yati is not None else F.array().cast("array<int>")
    size = F.length(glyphs)
    ends = F.concat(cuts, F.array(size))
    begins = F.concat(F.array(F.lit(0)), cuts)
    parts = F.zip_with(begins, ends, lambda a, b: F.trim(F.regexp_replace(F.substr(glyphs, a + 1, b - a), "(.{3})", "$1 ")))
    return F.concat(F.array_join(parts, " ‖ "), F.lit("*"))


def expand_feet(code: Column) -> Column:
    """Feet to L and G; null for an unknown foot or an empty code."""
    from kavyamill.dims import GANAS

    table = F.create_map(*[F.lit(x) for pair in GANAS.items() for x in pair])
    kept = F.regexp_replace(code, r"[\s_·-]", "")
    known = kept.rlike("^[" + "".join(GANAS) + "]+$")
    return F.when(known, F.array_join(F.transform(F.split(kept, ""), lambda x: F.element_at(table, x)), ""))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(values: Column, block: int = 64) -> Column:
    """Running sums of an array of numbers, by blocks, so that a long array isn't summed anew for each element."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y)
    running = lambda x: F.transform(F.filter(F.sequence(F.lit(0), F.size(x)), lambda i: i > 0), lambda i: total(F.slice(x, 1, i)))
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / block).cast("int")), lambda k: F.slice(v, k * block + 1, block))

    def joined(blocks: Column) -> Column:
        before = running(F.concat(F.array(F.lit(0)), F.transform(blocks, total)))
        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda x, carried: F.transform(running(x), lambda y: y + carried)))

    return bound(values, lambda v: bound(cut(v), joined))


def aksharas(text: Column) -> Column:
    """Written syllables of Devanagari or Kannada: independent vowels, and consonants that no virama follows."""
    return F.regexp_count(text, F.lit(r"[अ-औಅ-ಔ]|[क-हಕ-ಹ](?![्್])"))


def akshara_split(text: Column) -> Column:
    """Written syllables: a base begins one unless a virama stands before it."""
    base = r"[अ-औक-हಅ-ಔಕ-ಹ]"
    return F.filter(F.split(text, rf"(?<=.)(?<![्್])(?={base})"), lambda x: x != "")
