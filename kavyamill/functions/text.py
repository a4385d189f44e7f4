"""Cleaning, script detection, transliteration and sandhi as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kavyamill.functions.prosody import bound

# Letters of Devanagari and their roman forms.
DEVA_CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसहळ", "k kh g gh ṅ c ch j jh ñ ṭ ṭh ḍ ḍh ṇ t th d dh n p ph b bh m y r l v ś ṣ s h ḻ".split(), strict=True))
DEVA_VOWELS = dict(zip("अआइईउऊऋॠऌॡएऐओऔ", "a ā i ī u ū ṛ ṝ ḷ ḹ e ai o au".split(), strict=True))
DEVA_SIGNS = dict(zip("ािीुूृॄॢॣेैोौ", "ā i ī u ū ṛ ṝ ḷ ḹ e ai o au".split(), strict=True))
DEVA_MARKS = {"ं": "ṃ", "ः": "ḥ", "ँ": "m̐", "ऽ": "'", "।": ".", "॥": ".."}
SLP1_CONSONANTS = "kKgGNcCjJYwWqQRtTdDnpPbBmyrlvSzshL"
SLP1_VOWELS = "aAiIuUfFxXeEoO"
VIRAMA = "्"
SCRIPTS = (("devanagari", "ऀ-ॿ"), ("bengali", "ঀ-৿"), ("gurmukhi", "਀-੿"), ("gujarati", "઀-૿"), ("oriya", "଀-୿"), ("tamil", "஀-௿"), ("telugu", "ఀ-౿"), ("kannada", "ಀ-೿"), ("malayalam", "ഀ-ൿ"), ("grantha", "\\x{11300}-\\x{1137F}"))
IAST_LETTERS = "āīūṛṝḷḹṃṁḥṅñṭḍṇśṣĀĪŪṚṜḶḸṂṀḤṄÑṬḌṆŚṢ"

_CONS = "".join(DEVA_CONSONANTS)
_SIGN = "".join(DEVA_SIGNS)


def beyond_ascii(text: Column) -> Column:
    """The characters of a text beyond ASCII, in order. An ASCII text, which has a byte a character, is not searched."""
    return F.when(F.octet_length(text) == F.char_length(text), F.when(text.isNotNull(), "")).otherwise(F.regexp_replace(text, r"[\x00-\x7F]++", ""))


def script_of(text: Column) -> Column:
    """Block of the first character that is in one of ten Brahmic blocks; devanagari without any."""

    def block_of(first: Column) -> Column:
        out = F.lit("devanagari")
        for name, block in reversed(SCRIPTS):
            out = F.when(first.rlike(f"[{block}]"), name).otherwise(out)
        return out

    return bound(F.regexp_extract(beyond_ascii(text), "([" + "".join(r for _, r in SCRIPTS) + "])", 1), block_of)


def script_by_share(text: Column) -> Column:
    """devanagari above 30 % of the characters, else iast with a roman diacritic, else unknown."""
    size = F.length(text)
    return bound(beyond_ascii(text), lambda x: F.when(F.regexp_count(x, F.lit(r"[ऀ-ॿ]")) > size * 0.3, "devanagari").when(x.rlike(f"[{IAST_LETTERS}]"), "iast").otherwise("unknown"))


def script_strict(text: Column) -> Column:
    """devanagari, iast, mixed or none, by the letters present."""
    deva, latin = text.rlike(r"[ऄ-हक़-ॡ]"), text.rlike(r"\p{IsLatin}")
    return F.when(deva & latin, "mixed").when(deva, "devanagari").when(latin, "iast").otherwise("none")


def clean_for_language(text: Column) -> Column:
    """Digits and dandas become blanks, other punctuation goes, blanks are squeezed."""
    out = F.regexp_replace(text, r"[0-9०-९।॥]", " ")
    out = F.regexp_replace(out, r"[^\p{L}\p{M}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def strip_editorial(text: Column) -> Column:
    return F.translate(text, "()\"'“”‘’-‌", "")


def strip_numerals(text: Column) -> Column:
    """A verse number before dandas becomes a double danda; other digits go."""
    return F.regexp_replace(F.regexp_replace(text, r"\s*[०-९0-9]+\s*[।॥]+", "॥"), r"[०-९0-9]+", "")


def expand_om(text: Column) -> Column:
    return F.replace(text, F.lit("ॐ"), F.lit("ओम्"))


def collapse(text: Column) -> Column:
    out = F.regexp_replace(text, r"\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"॥(\s*॥)+", "॥"), r"।(\s*।)+", "।"))


def rewrite_adjacent(text: Column) -> Column:
    """Visarga before k and p sounds, anusvara before stops, ya and word ends, by the next character alone."""
    out = F.regexp_replace(F.regexp_replace(text, "ः([कख])", "ᳵ$1"), "ः([पफ])", "ᳶ$1")
    for row, nasal in (("कखगघङ", "ङ्"), ("चछजझञ", "ञ्"), ("टठडढण", "ण्"), ("तथदधन", "न्"), ("पफबभम", "म्")):
        out = F.regexp_replace(out, f"ं(?=[{row}])", nasal)
    return F.regexp_replace(F.regexp_replace(out, "ं(?=य)", "ँ"), r"ं(?=$|[ \t\n।॥])", "म्")


def normalize_recitation(text: Column) -> Column:
    return collapse(rewrite_adjacent(expand_om(strip_numerals(strip_editorial(text)))))


def strip_punctuation(text: Column) -> Column:
    """A Latin colon is a visarga; dandas, quotes, digits and hyphens go, so that compounds join."""
    out = F.replace(F.replace(text, F.lit(":-"), F.lit("ः")), F.lit(":"), F.lit("ः"))
    out = F.regexp_replace(out, r"[\p{Nd}।॥|/\\—–\"'“”‘’„«»‹›*•·().,;!?‌‍-]", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def phonetic(text: Column, kannada_safe: bool = False) -> Column:
    """Visarga and anusvara by the next sounding character, across blanks; a final visarga stays."""
    out = strip_punctuation(text)
    if not kannada_safe:
        out = F.regexp_replace(F.regexp_replace(out, r"ः(?=\s*[कख])", "ᳵ"), r"ः(?=\s*[पफ])", "ᳶ")
    for row, sibilant in (("शचछ", "श्"), ("षटठ", "ष्"), ("सतथ", "स्")):
        out = F.regexp_replace(out, rf"ः(?=\s*[{row}])", sibilant)
    for row, nasal in (("कखगघ", "ङ्"), ("चछजझ", "ञ्"), ("टठडढ", "ण्"), ("तथदध", "न्"), ("पफबभ", "म्")):
        out = F.regexp_replace(out, rf"ं(?=\s*[{row}])", nasal)
    return out


def deva_to_slp1(text: Column) -> Column:
    """One character a phoneme: a consonant without a sign gets its vowel, a virama takes it away."""
    out = F.regexp_replace(text, f"([{_CONS}])(?![{_SIGN}{VIRAMA}])", "$1अ")
    signs = F.translate(out, _SIGN + VIRAMA, SLP1_VOWELS[1:])
    return F.translate(signs, _CONS + "".join(DEVA_VOWELS) + "ंःँऽᳵᳶ।॥", SLP1_CONSONANTS + SLP1_VOWELS + "MH~'ZV||")


def slp1_to_iast(text: Column) -> Column:
    """Roman letters; sounds of two letters after the others, as no letter that those give is a sound's."""
    pairs = [*zip(SLP1_CONSONANTS, DEVA_CONSONANTS.values(), strict=True), *zip(SLP1_VOWELS, DEVA_VOWELS.values(), strict=True), ("M", "ṃ"), ("H", "ḥ"), ("~", "m̐")]
    out = F.translate(text, "".join(a for a, b in pairs if len(b) == 1), "".join(b for _, b in pairs if len(b) == 1))
    for one, letters in pairs:
        if len(letters) > 1:
            out = F.replace(out, F.lit(one), F.lit(letters))
    return out


def deva_to_iast(text: Column) -> Column:
    """Roman form; a danda becomes a full stop, a double one two."""
    dotted = F.replace(F.replace(text, F.lit("॥"), F.lit("..")), F.lit("।"), F.lit("."))
    return slp1_to_iast(deva_to_slp1(dotted))


def iast_to_deva(text: Column) -> Column:
    """Devanagari: a consonant before no vowel takes a virama."""
    return lowered_to_deva(F.lower(F.trim(text)))


def lowered_to_deva(text: Column) -> Column:
    """iast_to_deva() of a text in lower case without blanks at its ends."""
    out = F.replace(F.replace(text, F.lit("’"), F.lit("'")), F.lit("`"), F.lit("'"))
    letters = {**{v: k for k, v in DEVA_CONSONANTS.items()}}
    for roman in sorted(letters, key=len, reverse=True):
        out = F.replace(out, F.lit(roman), F.lit(letters[roman] + VIRAMA))
    signs = {v: k for k, v in DEVA_SIGNS.items()}
    for roman in sorted(signs, key=len, reverse=True):
        out = F.replace(out, F.lit(VIRAMA + roman), F.lit(signs[roman]))
    out = F.replace(out, F.lit(VIRAMA + "a"), F.lit(""))
    vowels = {v: k for k, v in DEVA_VOWELS.items()}
    for roman in sorted(vowels, key=len, reverse=True):
        out = F.replace(out, F.lit(roman), F.lit(vowels[roman]))
    return F.translate(out, "ṃṁḥ'", "ंंःऽ")


def slp1_to_kannada(text: Column) -> Column:
    """SLP1 to Kannada by way of Devanagari's order: both blocks are laid out alike, 0x380 apart."""
    return deva_to_kannada(iast_to_deva(slp1_to_iast(text)))


def deva_to_kannada(text: Column) -> Column:
    deva = _CONS + "".join(DEVA_VOWELS) + _SIGN + VIRAMA + "ंः"
    return F.translate(text, deva, "".join(chr(ord(c) + 0x380) for c in deva))


def visarga_sandhi(slp1: Column) -> Column:
    """utva, rutva and lopa at word borders of blank-separated SLP1; each rule sees what the one before left.

    Words are folded from left to right, since an elided a is written into the next word.
    """
    voiced, vowels = "gGjJqQdDbBNYRnmyrlvh", "aAiIuUfFxXeEoO"
    words = F.split(slp1, " ")
    n = F.size(words)

    def step(state: Column, i: Column) -> Column:
        word, nxt = state["word"], F.coalesce(F.get(words, i + 1), F.lit(""))
        first, vowel = F.substring(nxt, 1, 1), F.substr(word, F.length(word) - 1, F.lit(1))
        base, stem = F.substr(word, F.lit(1), F.length(word) - 1), F.substr(word, F.lit(1), F.length(word) - 2)
        applies = word.endswith("H") & (i < n - 1) & (F.length(word) >= 2)
        lengthened = F.translate(vowel, "aiuf", "AIUF")
        elides = applies & (vowel == "a") & (first == "a")
        is_voiced, is_vowel = first.isin(*voiced), first.isin(*vowels)
        new = (
            F.when(~applies, word)
            .when(first == "r", F.concat(stem, lengthened))
            .when(word.isin("saH", "ezaH") & (first != "a"), base)
            .when(~is_vowel & ~is_voiced, word)
            .when((vowel == "a") & ((first == "a") | is_voiced), F.concat(stem, F.lit("o")))
            .when(vowel.isin("a", "A"), base)
            .when(vowel.isin(*"iIuUfFxXeEoO"), F.concat(base, F.lit("r")))
            .otherwise(word)
        )
        following = F.when(elides, F.concat(F.lit("'"), F.substr(nxt, F.lit(2)))).otherwise(nxt)
        return F.struct(F.concat(state["out"], F.array(new)).alias("out"), following.alias("word"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.get(words, F.lit(0)).alias("word"))
    return F.array_join(F.aggregate(F.sequence(F.lit(0), n - 1), start, step)["out"], " ")


def visarga_echo(slp1: Column) -> Column:
    """The last word's visarga becomes h and its vowel again."""
    return F.regexp_replace(slp1, "([aAiIuUfFxXeEoO])H$", "$1h$1")


def model_text(deva: Column, sandhi: bool = False, echo: bool = True) -> Column:
    """Kannada letters for reciting: plain, or with sandhi and the final echo."""
    slp1 = deva_to_slp1(strip_punctuation(deva))
    if sandhi:
        slp1 = visarga_sandhi(slp1)
        slp1 = visarga_echo(slp1) if echo else slp1
    return slp1_to_kannada(F.replace(slp1, F.lit("F"), F.lit("rU")))


def aligner_slp1(deva: Column) -> Column:
    out = deva_to_slp1(strip_punctuation(deva))
    out = F.replace(F.translate(F.translate(out, "'|", ""), "L", "l"), F.lit("F"), F.lit("rU"))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def word_phones(slp1: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(slp1, "[^aAiIuUfFxXeEoOkKgGNcCjJYwWqQRtTdDnpPbBmyrlvSzshMH~]", ""), "(.)", "$1 "))


def kannada_final(text: Column) -> Column:
    """A final visarga echoes after a short vowel, a final anusvara becomes m."""
    t = F.regexp_replace(text, r"\s+$", "")
    echo = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "ಿಃ$", "ಿಹಿ"), "ುಃ$", "ುಹು"), "ೃಃ$", "ೃಹೃ")
    echo = F.regexp_replace(echo, "(?<![ಾೀೂೄೆೇೈೊೋೌ])ಃ$", "ಹ")
    core = F.regexp_replace(F.regexp_replace(F.regexp_replace(echo, "ಿಹಿ$", "ಹಿ"), "ುಹು$", "ಹು"), "ೃಹೃ$", "ಹೃ")
    return F.regexp_replace(F.when(t.rlike("[ಿುೃ]ಃ$"), F.concat(F.regexp_replace(t, "ಃ$", ""), F.regexp_extract(core, "(ಹ[ಿುೃ])$", 1))).otherwise(echo), "ಂ$", "ಮ್")


def kannada_nasals(text: Column) -> Column:
    out = text
    for row, nasal in (("ಕಖಗಘಙ", "ಙ್"), ("ಚಛಜಝಞ", "ಞ್"), ("ಟಠಡಢಣ", "ಣ್"), ("ತಥದಧನ", "ನ್")):
        out = F.regexp_replace(out, f"ಂ(?= *[{row}])", nasal)
    return F.regexp_replace(out, "ಂ(?= *[^ ])", "ಮ್")


def kannada_satva(text: Column) -> Column:
    """Visarga before c, ṭ and t sounds becomes their sibilant, and the words join."""
    out = text
    for row, sibilant in (("ಚಛ", "ಶ್"), ("ಟಠ", "ಷ್"), ("ತಥ", "ಸ್")):
        out = F.regexp_replace(out, f"ಃ *([{row}])", f"{sibilant}$1")
    return out


def kannada_before_ksha(text: Column) -> Column:
    out = text
    for sign in "ಿುೃ":
        out = F.regexp_replace(out, f"{sign}ಃ(?= *ಕ್ಷ)", f"{sign}ಹ{sign}")
    return F.regexp_replace(out, "(?<![ಾೀೂೄೆೇೈೊೋೌ])ಃ(?= *ಕ್ಷ)", "ಹ")


def kannada_metathesis(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("ಹ್ಣ"), F.lit("ಣ್ಹ")), F.lit("ಹ್ನ"), F.lit("ನ್ಹ"))


def kannada_vocalic_l(text: Column) -> Column:
    out = text
    for a, b in (("ೢ", "್ಲೃ"), ("ೣ", "್ಲೄ"), ("ಌ", "ಲೃ"), ("ೡ", "ಲೄ")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def ends_halant(text: Column) -> Column:
    return F.regexp_replace(text, r"[ ।॥|.,:;!?‌‍]+$", "").rlike("[्್]$")


def ascii_scheme_guard(text: Column) -> Column:
    """Whether a roman text is in a doubled-letter ASCII scheme rather than in diacritics."""
    return F.lower(text).rlike(r"aa|ii|uu|chh|sh|\.r|r\^i|~n")


def ascii_fold(text: Column) -> Column:
    """Letters of the aligner: diacritics folded, ch written c, hyphens blanks, all else gone."""
    out = text
    for a, b in (("śhrī", "śrī"), ("śh", "ś"), ("ṣh", "ṣ"), ("ch", "c"), ("ṛi", "ṛ"), ("’", "'")):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.translate(out, "āīūṛṝḷṅñṇṃṁṭḍśṣḥ'-", "aiurrlnnnmmtdssh\u0000 ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.replace(out, F.lit("\u0000"), F.lit(""))), r"[^a-z\s]", ""), r"\s+", " "))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text. Sorted, equal characters make one run each."""
    n = F.length(text)
    runs = F.regexp_extract_all(F.array_join(F.sort_array(F.split(text, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    # -sum(k/n log k/n) = log n - sum(k log k) / n, so that n is not counted again for each run
    weighted = F.aggregate(runs, F.lit(0.0), lambda a, run: a + F.length(run) * F.log2(F.length(run)))
    return F.when(n > 0, F.log2(n) - weighted / n).otherwise(F.lit(0.0))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^a-zA-Z0-9._-]", "_")


def syllable_count(iast: Column) -> Column:
    out = F.lower(iast)
    for a, b in (("śh", "ś"), ("ṣh", "ṣ"), ("ch", "c"), ("ṛi", "ṛ")):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.replace(F.replace(out, F.lit("ai"), F.lit("E")), F.lit("au"), F.lit("O"))
    return F.regexp_count(out, F.lit("[aāiīuūṛṝḷeoEO]"))


def chunks(text: Column, most: int = 8000) -> Column:
    """Pieces of a long text: parts end at dandas or blank lines and are packed greedily up to `most` characters."""
    parts = F.split(text, r"(?<=[।॥])\s+|\n{2,}")

    def step(state: Column, part: Column) -> Column:
        full = (state["size"] + F.length(part) > most) & (F.size(state["now"]) > 0)
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(F.array_join(state["now"], " ")))).otherwise(state["done"]).alias("done"),
            F.when(full, F.array(part)).otherwise(F.concat(state["now"], F.array(part))).alias("now"),
            F.when(full, F.length(part)).otherwise(state["size"] + F.length(part)).alias("size"),
        )

    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("now"), F.lit(0).alias("size"))
    packed = F.aggregate(parts, start, step, lambda s: F.concat(s["done"], F.array(F.array_join(s["now"], " "))))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(packed)


def one_verse_error(text: Column) -> Column:
    """Null for a single verse, else what is wrong."""
    from kavyamill.functions.prosody import aksharas

    marked = F.replace(F.coalesce(text, F.lit("")), F.lit("।।"), F.lit("॥"))
    several = F.length(marked) - F.length(F.replace(marked, F.lit("॥"), F.lit(""))) >= 2
    return F.when(several, "several verses").when(aksharas(F.coalesce(text, F.lit(""))) > 100, "too long")
