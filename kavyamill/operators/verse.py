"""Whole verses: pāda splitting, script and diagnostics, syllable tables, compact meter detectors, labels, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kavyamill import dims
from kavyamill.functions import prosody as P
from kavyamill.functions import text as X

# The reciters' own table of pāda patterns - name, patterns that a pāda may have; order is precedence.
RECITATION_METERS = (
    ("indravajra", ("GGLGGLLGLGG",)),
    ("upendravajra", ("LGLGGLLGLGG",)),
    ("upajati", ("GGLGGLLGLGG", "LGLGGLLGLGG")),
    ("vamshastha", ("LGLGGLLGLGLG",)),
    ("indravamsha", ("GGLGGLLGLGLG",)),
    ("vasantatilaka", ("GGLGLLLGLLGLGG",)),
    ("malini", ("LLLLLLGGLGGLGGG",)),
    ("shikharini", ("LGGGGGLLLLLGGGGLG",)),
    ("mandakranta", ("GGGGLLLLLGGLGGLGG",)),
    ("harini", ("LLLLLGGGGGLGLLGLG",)),
    ("prithvi", ("LGLLLGLGLLLGGLGGL",)),
    ("shardulavikridita", ("GGGLLGLGLLLGGGLGGLG",)),
    ("sragdhara", ("GGGGLGGGLLLLLLGGLGGLG",)),
)
# Patterns that the labeler names, and where their caesuras fall.
SIGNATURES = {"GGLGGLLGLGG": "indravajrā(11)", "LGLGGLLGLGG": "upendravajrā(11)", "LGLGGLLGLGLG": "vaṃśastha(12)", "GGLGLLLGLLGLGG": "vasantatilakā(14)", "LLLLLLGGGLGGLGG": "mālinī(15)", "GGGGLLLLLGGLGGLGG": "mandākrāntā(17)", "LGGGGGLLLLLGGLLLG": "śikhariṇī(17)", "LGLLLGLGLLLGLGGLG": "pṛthvī(17)", "GGGLLGLGLLLGGGLGGLG": "śārdūlavikrīḍita(19)", "GGGGLGGLLLLLLGGLGGLGG": "sragdharā(21)"}
LABEL_YATI = {"mālinī(15)": [8], "śikhariṇī(17)": [6], "mandākrāntā(17)": [4, 10], "śārdūlavikrīḍita(19)": [12], "sragdharā(21)": [7, 14]}
# The line identifier's compact table, last place free.
LINE_METERS = (("indravajrā", "GGLGGLLGLGG"), ("upendravajrā", "LGLGGLLGLGG"), ("vaṁśastha", "LGLGGLLGLGLG"), ("indravaṁśā", "GGLGGLLGLGLG"), ("drutavilambita", "LLLGLLGLLGLG"), ("vasantatilakā", "GGLGLLLGLLGLGG"), ("mālinī", "LLLLLLGGGLGGLGG"), ("śikhariṇī", "LGGGGGLLLLLGGLLLG"), ("mandākrāntā", "GGGGLLLLLGGLGGLGG"), ("hariṇī", "LLLLLGGGGLGLLLGLG"), ("śārdūlavikrīḍita", "GGGLLGLGLLLGGGLGGLG"), ("sragdharā", "GGGGLGGLLLLLLGGLGGLGG"))
LINE_FAMILIES = (("upajāti (indravajrā–upendravajrā)", ("indravajrā", "upendravajrā")), ("upajāti (vaṁśastha–indravaṁśā)", ("vaṁśastha", "indravaṁśā")))
INVOCATION = "leading line outside the verse"
SPEAKERS = ("धृतराष्ट्र उवाच", "सञ्जय उवाच", "अर्जुन उवाच", "श्रीभगवानुवाच", "भगवानुवाच")


def boundary_mode(text: Column) -> Column:
    """Lines where there is a line break, else dandas, else the whole."""
    return F.when(text.rlike(r"[\r\n]"), "lines").when(text.rlike(r"[।॥|]"), "dandas").otherwise("single")


def padas(text: Column, mode: Column) -> Column:
    """Trimmed parts that are not blank; parts of digits alone after a danda are verse numbers and go."""
    parts = F.when(mode == "lines", F.split(text, r"\r\n|\r|\n")).when(mode == "dandas", F.split(text, r"[।॥|]+")).otherwise(F.array(text))
    trimmed = F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|[\s।॥|]*[0-9०-९]*[\s।॥|]*$", ""))
    return F.filter(trimmed, lambda p: p != "")


def line_column(text: Column, offset: Column) -> Column:
    """(line, column) from 1 of a character offset from 0; \\r\\n is one line break."""
    before = F.regexp_replace(F.substr(text, F.lit(1), offset), r"\r\n?", "\n")
    tail = F.regexp_extract(before, r"([^\n]*)\z", 1)  # $ would stand before a last line break
    return F.struct((F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line"), (F.length(tail) + 1).alias("column"))


def analyze(verses: DataFrame) -> DataFrame:
    """verse_id, script, boundary_mode, padas (text, canonical, pattern, matras), totals, diagnostics and ok.

    Input has verse_id and text. Errors are rows' data: mixed-script, no-letters, ascii-scheme and unknown-character make
    ok false; candrabindu and pluta digits are notes. A 3 right after a vowel marks a syllable of three mātrās.
    """
    rows = verses.select("verse_id", "text", X.script_strict(F.col("text")).alias("script"), boundary_mode(F.col("text")).alias("boundary_mode"))
    rows = rows.withColumn("parts", padas(F.col("text"), F.col("boundary_mode")))
    plain = lambda p: F.regexp_replace(p, r"(?<=[aāiīuūṛṝḷḹeoअ-औा-ौक-ह])[3३]", "")
    canonical = lambda p: F.when(F.col("script") == "devanagari", P.letters(X.deva_to_slp1(p))).otherwise(P.canonical_iast(p))
    pluta = lambda p: F.length(p) - F.length(plain(p))

    def pada(p: Column) -> Column:
        c = canonical(plain(p))
        pattern = _pattern_of(c)
        return F.struct(p.alias("text"), c.alias("canonical"), pattern.alias("pattern"), (P.matras(pattern) + pluta(p)).alias("matras"))

    rows = rows.withColumn("padas", F.transform("parts", pada))
    unknown = F.exists("padas", lambda p: P.unknown_characters(p["canonical"]) != "")
    flags = {
        "mixed-script": F.col("script") == "mixed",
        "no-letters": F.col("script") == "none",
        "ascii-scheme": (F.col("script") == "iast") & X.ascii_scheme_guard(F.col("text")),
        "unknown-character": F.col("script").isin("iast", "devanagari") & unknown,
        "candrabindu": F.contains(F.col("text"), F.lit("̐")) | F.contains(F.col("text"), F.lit("ँ")),
        "pluta": plain(F.col("text")) != F.col("text"),
    }
    rows = rows.withColumn("diagnostics", F.array_compact(F.array(*[F.when(bad, name) for name, bad in flags.items()])))
    joined = F.array_join(F.transform("padas", lambda p: p["pattern"]), "")
    heavy = F.length(F.translate(joined, "L", ""))
    totals = F.struct(F.size("padas").alias("padas"), F.length(joined).alias("syllables"), (F.length(joined) - heavy).alias("laghu"), heavy.alias("guru"), F.aggregate("padas", F.lit(0), lambda a, p: a + p["matras"]).alias("matras"))
    ok = ~F.arrays_overlap("diagnostics", F.array(*map(F.lit, ("mixed-script", "no-letters", "ascii-scheme", "unknown-character")))) & (F.size("padas") > 0)
    return rows.select("verse_id", "script", "boundary_mode", "padas", totals.alias("totals"), "diagnostics", ok.alias("ok"))


def _pattern_of(clean: Column) -> Column:
    """As iast_pattern(), of canonical text."""
    found = P.tokens(clean)

    def weigh(token: Column, i: Column) -> Column:
        after = F.substr(token, F.lit(2))
        consonants = F.length(F.translate(after, "MH", ""))
        heavy = F.substring(token, 1, 1).isin(*P.LONG) | after.rlike("[MH]") | (consonants >= 2) | ((i == F.size(found) - 1) & (consonants >= 1))
        return F.when(heavy, "G").otherwise("L")

    return F.array_join(F.transform(found, weigh), "")


def recitation_meter(pattern: Column) -> Column:
    """(name, pada_length, num_padas) by the reciters' table: four pādas whose last syllables are free, the first name
    that fits; else 32 syllables are anushtubh, 16 half of it."""
    out = F.when(F.length(pattern) == 32, F.struct(F.lit("anushtubh").alias("name"), F.lit(8).alias("pada_length"), F.lit(4).alias("num_padas"))).when(F.length(pattern) == 16, F.struct(F.lit("anushtubh_half").alias("name"), F.lit(8).alias("pada_length"), F.lit(2).alias("num_padas")))
    out = out.otherwise(F.struct(F.lit("unknown").alias("name"), F.lit(None).cast("int").alias("pada_length"), F.lit(None).cast("int").alias("num_padas")))
    for name, patterns in reversed(RECITATION_METERS):
        one = "(" + "|".join(p[:-1] for p in patterns) + ")."
        n = len(patterns[0])
        out = F.when(pattern.rlike(f"^(?:{one}){{4}}$"), F.struct(F.lit(name).alias("name"), F.lit(n).alias("pada_length"), F.lit(4).alias("num_padas"))).otherwise(out)
    return out


def sutra_mask(syllables: Column) -> Column:
    """1 for each syllable (text, is_pada_final) of a sūtra, 0 for the others: a first lone om that ends a pāda, and each
    stretch from an om that begins a phrase to the next om that ends one."""

    def code(s: Column, i: Column) -> Column:
        starts = (i == 0) | F.coalesce(F.get(syllables, i - 1)["is_pada_final"], F.lit(False))
        return F.when((s["text"] == "om") & s["is_pada_final"], "F").when((s["text"] == "om") & starts, "O").otherwise("x")

    codes = F.array_join(F.transform(syllables, code), "")
    stretches = F.regexp_extract_all(codes, F.lit("(O[^F]*F|.)"), F.lit(1))
    mask = F.array_join(F.transform(stretches, lambda p: F.when(F.length(p) > 1, F.repeat(F.lit("1"), F.length(p))).otherwise("0")), "")
    return F.when(codes.startswith("F"), F.concat(F.lit("1"), F.substr(mask, F.lit(2)))).otherwise(mask)


def pada_positions(mask: Column, pada_length: Column) -> Column:
    """(pada_index, pos, pos_norm) of each syllable; -1 in a sūtra, which does not count on; one pāda if the length is unknown."""

    def place(c: Column, i: Column) -> Column:
        k = F.length(F.replace(F.substr(mask, F.lit(1), i), F.lit("1"), F.lit("")))
        sutra = c == "1"
        return F.struct(
            F.when(sutra, -1).when(pada_length.isNull(), 0).otherwise(F.floor(k / pada_length).cast("int")).alias("pada_index"),
            F.when(sutra, -1).when(pada_length.isNull(), k).otherwise((k % pada_length).cast("int")).alias("pos"),
            F.when(sutra, -1.0).when(pada_length.isNull(), 0.0).otherwise((k % pada_length) / F.greatest(F.lit(1), pada_length - 1)).alias("pos_norm"),
        )

    return F.transform(F.filter(F.split(mask, ""), lambda c: c != ""), place)


def syllables_by_onset(slp1: Column) -> Column:
    """Texts of syllables where of a cluster between vowels only the last consonant goes to the next one; blanks and
    pauses end a syllable, what has no vowel joins the one before."""
    v = P.VOWELS
    plain = F.replace(slp1, F.lit("'"), F.lit(""))
    cut = F.regexp_replace(F.regexp_replace(plain, rf"([{v}])(?=[{v}])", "$1."), rf"([{v}])([^{v} |.]*?)([^{v} |.~]~?)(?=[{v}])", "$1$2.$3")
    joined = F.regexp_replace(cut, rf"[ |]+([^{v} |.]+)(?=[ |]|$)", "$1")
    return F.filter(F.split(joined, r"[ .|]+"), lambda s: s != "")


def label_of(pattern: Column) -> Column:
    """The labeler's name of a pāda's pattern, or its length in parentheses."""
    table = F.create_map(*[F.lit(x) for pair in SIGNATURES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, pattern), F.concat(F.lit("("), F.length(pattern), F.lit(")")))


def line_identity(lines: Column) -> Column:
    """(label, note) of a verse's line patterns: all of eight, or the last four of one meter or of two siblings."""
    last = F.slice(lines, F.greatest(F.size(lines) - 3, F.lit(1)), 4)
    four = F.size(lines) >= 4
    fits = lambda p: (lambda x: (F.length(x) == len(p)) & x.startswith(p[:-1]))
    by_name = dict(LINE_METERS)
    label = F.lit("unidentified")
    for name, (a, b) in reversed(LINE_FAMILIES):
        label = F.when(four & F.forall(last, _either(by_name[a], by_name[b])), name).otherwise(label)
    for name, p in reversed(LINE_METERS):
        label = F.when(four & F.forall(last, fits(p)), name).otherwise(label)
    eight = lambda x: F.length(x) == 8
    label = F.when((F.size(lines) > 0) & (F.forall(lines, eight) | (four & F.forall(last, eight))), "anuṣṭubh (śloka)").otherwise(label)
    note = F.when((F.size(lines) > 4) & (label != "unidentified") & ~F.forall(lines, eight), INVOCATION)
    return F.struct(label.alias("label"), note.alias("note"))


def _either(a: str, b: str):
    return lambda x: (F.length(x) == len(a)) & (x.startswith(a[:-1]) | x.startswith(b[:-1]))


def word_head(word: Column) -> Column:
    """(head, tail): the first written syllable of a roman word and the rest; a word without a vowel is all head."""
    pattern = r"^(['’]*(?:kh|gh|ch|jh|ṭh|ḍh|th|dh|ph|bh|[kgṅcjñṭḍṇtdnpbmyrlvśṣshḻ])*(?:ai|au|[āīūṝḹeoaiuṛḷ])(?:m̐|[ṁṃḥẖḫ])?)(.*)$"
    found = word.rlike(pattern)
    return F.struct(F.when(found, F.regexp_extract(word, pattern, 1)).otherwise(word).alias("head"), F.when(found, F.regexp_extract(word, pattern, 2)).otherwise("").alias("tail"))


def yati_boundary(line: Column, yati: Column) -> Column:
    """The word (from 0) after which `yati` syllables are full; null inside a word and after the last."""
    words = F.split(F.trim(line), r"\s+")
    sizes = F.transform(words, lambda w: F.size(P.tokens(P.canonical_iast(w))))
    at = F.array_position(P.prefix_sums(sizes), yati)
    return F.when((at > 0) & (at < F.size(words)), at - 1)


def kannada_weights(text: Column, slp1: Column) -> Column:
    """For each character 1 in a light syllable, 2 in a heavy one, 0 outside; null unless there are as many written
    syllables as scanned ones."""
    base, sign = "ಅ-ಔಕ-ಹೞ", "ಾ-ೌೕೖಂಃ"
    syllable = rf"[{base}](?:್[{base}])*[{sign}]*(?:[{base}]್(?![{base}]))*್?"
    parts = F.regexp_extract_all(text, F.lit(f"({syllable}|(?s:.))"), F.lit(1))
    is_syllable = lambda p: p.rlike(f"^[{base}]")
    weights = P.weights(P.letters(slp1))
    n = F.size(F.filter(parts, is_syllable))
    number = lambda i: F.size(F.filter(F.slice(parts, 1, i + 1), is_syllable)) - 1
    digit = lambda p, i: F.when(is_syllable(p), F.repeat(F.when(F.get(weights, number(i)) == "G", "2").otherwise("1"), F.length(p))).otherwise(F.repeat(F.lit("0"), F.length(p)))
    return F.when(n == F.size(weights), F.array_join(F.transform(parts, digit), ""))


def unit_kind(text: Column, verse: Column, part: Column, filename: Column) -> Column:
    """title, colophon, speaker or verse, in this precedence."""
    has = lambda s: F.contains(text, F.lit(s))
    title = (verse == 0) | F.contains(F.lower(part), F.lit("title")) | (has("अध्याय") & ~has("ब्रह्मविद्या") & ~has("संवादे") & ~has("तत्सदिति"))
    colophon = has("तत्सदिति") | has("पुष्पिका") | F.contains(F.lower(filename), F.lit("colophon")) | (has("ब्रह्मविद्या") & has("योगशास्त्रे")) | (has("संवादे") & has("अध्याय"))
    speaker = F.contains(F.lower(part), F.lit("speaker")) | F.contains(F.lower(filename), F.lit("speaker")) | F.trim(text).isin(*SPEAKERS)
    return F.when(title, "title").when(colophon, "colophon").when(speaker, "speaker").otherwise("verse")


def verdict_label(name: Column, count_class: Column, syllables: Column, status: Column) -> Column:
    """One line for a verdict, which never says more than the status allows."""
    repeats = F.contains(F.lower(name), F.lower(count_class))
    size = F.when(count_class.isNull(), "").when(repeats, F.concat(F.lit(" — "), syllables, F.lit(" akṣara"))).otherwise(F.concat(F.lit(" ("), count_class, F.lit(" — "), syllables, F.lit(" akṣara)")))
    tail = F.when(status == "identified", "").when(status == "provisional", " — provisional").when(status == "ambiguous", " — ambiguous").when(status == "insufficient-evidence", " — fragment only")
    return F.coalesce(F.concat(name, size, tail), F.lit("unidentified metre"))


def authority(meter_id: Column, tradition: Column) -> Column:
    return F.when(meter_id.isin(*dims.DUAL_AUTHORITY), "dual-root-bhasya").when(tradition == "vedic", "none").otherwise("single-root")


def bank_lookup(rows: DataFrame, bank: DataFrame, meter: str, default: str) -> DataFrame:
    """rows with a bank's wav by meter name or by the wav's own stem, case ignored, keys that begin with _ left out; a
    missing one gets the default meter's. bank: meter, wav; one entry a meter, so its size is that of a table of meters."""
    named = bank.where(~F.col("meter").startswith("_"))
    stem = F.lower(F.regexp_replace("wav", r"\.wav$", ""))
    keys = named.select(F.explode(F.array(F.struct(F.lit(0).alias("p"), F.lower("meter").alias("k")), F.struct(F.lit(1).alias("p"), stem.alias("k")))).alias("x"), "wav")
    best = keys.groupBy(F.col("x.k").alias("_k")).agg(F.min_by("wav", F.struct("x.p", "wav")).alias("_wav"))
    other = best.where(F.col("_k") == default).select(F.col("_wav").alias("_default"))
    found = rows.join(best, F.lower(F.col(meter)) == F.col("_k"), "left").join(other, how="left")
    return found.withColumn("wav", F.coalesce("_wav", "_default")).drop("_k", "_wav", "_default")


def packed_words(text: Column, most: int = 24) -> Column:
    """Words packed greedily into pieces of at most `most` written syllables; a longer word is a piece of its own."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("now"), F.lit(0).alias("size"))

    def step(s: Column, w: Column) -> Column:
        n = P.aksharas(w)
        full = (s["size"] + n > most) & (F.size(s["now"]) > 0)
        return F.struct(F.when(full, F.concat(s["done"], F.array(F.array_join(s["now"], " ")))).otherwise(s["done"]).alias("done"), F.when(full, F.array(w)).otherwise(F.concat(s["now"], F.array(w))).alias("now"), F.when(full, n).otherwise(s["size"] + n).alias("size"))

    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    return F.aggregate(words, start, step, lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(F.array_join(s["now"], " ")))).otherwise(s["done"]))


def repeat_depths(syllables: Column) -> Column:
    """(mono, di): the longest run of one syllable, and of one pair of different syllables."""
    n = F.size(syllables)
    at = lambda i: F.get(syllables, i)
    places = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    mono = F.aggregate(places, F.struct(F.lit(0).alias("run"), F.lit(1).alias("best")), lambda s, i: F.struct(F.when((i > 0) & (at(i) == at(i - 1)), s["run"] + 1).otherwise(1).alias("run"), F.greatest(s["best"], F.when((i > 0) & (at(i) == at(i - 1)), s["run"] + 1).otherwise(1)).alias("best")), lambda s: s["best"])
    # A stretch in which each syllable equals the one two before it, and not the one before, of m syllables has m // 2 pairs.
    go = lambda i: (i > 1) & (at(i) == at(i - 2)) & (at(i) != at(i - 1))
    di = F.aggregate(places, F.struct(F.lit(0).alias("run"), F.lit(1).alias("best")), lambda s, i: F.struct(F.when(go(i), s["run"] + 1).otherwise(F.when((i > 0) & (at(i) != at(i - 1)), 2).otherwise(1)).alias("run"), F.greatest(s["best"], F.when(go(i), F.floor((s["run"] + 1) / 2).cast("int")).otherwise(1)).alias("best")), lambda s: s["best"])
    return F.struct(mono.alias("mono"), di.alias("di"))


def segment_size(total: Column, per_pada: Column) -> Column:
    """Syllables of a reciting unit: half verses of short meters, pādas of long ones; by the total where the meter is
    unknown; null below eight syllables and where nothing fits."""
    near = lambda n: total.between(n - 1, n + 1)
    size = F.when(per_pada == 8, F.when(total >= 24, 16).otherwise(8))
    size = size.when(per_pada.isin(11, 12, 14), F.when(total >= per_pada * 3, per_pada * 2).otherwise(per_pada))
    size = size.when(per_pada == 15, F.when(near(60), 30).otherwise(15)).when(per_pada.isin(17, 19, 21), per_pada)
    size = size.when(near(32), 16).when(near(44), 22).when(near(48), 24).when(near(56), 28)
    return F.when(total >= 8, size)


def recitation_pieces(written: Column, syllables: Column, per_pada: Column) -> Column:
    """Reciting units: the written pieces if there are as many as expected, four of them in pairs where two are, else
    cuts at every segment_size() syllables; the written pieces where the size is unknown or the verse too short."""
    total = F.size(syllables)
    size = segment_size(total, per_pada)
    expected = F.bround(total / size, 0)
    cuts = F.transform(F.sequence(F.lit(0), F.ceil(total / size).cast("int") - 1), lambda i: F.array_join(F.slice(syllables, i * size + 1, size), ""))
    paired = F.array(F.concat_ws(" ", F.get(written, F.lit(0)), F.get(written, F.lit(1))), F.concat_ws(" ", F.get(written, F.lit(2)), F.get(written, F.lit(3))))
    fits = size.isNotNull() & (total >= size * 1.4)
    chosen = F.when(F.size(written) == expected, written).when((F.size(written) == 4) & (expected == 2), paired).when(F.size(cuts) >= 2, cuts)
    return F.coalesce(F.when(fits, chosen), written)


def hemistich_candidate(whole: DataFrame, halved: DataFrame) -> DataFrame:
    """Verdicts of whole verses, and where there is none those of the verse read as a half and doubled; a doubled
    verse is not taken for vegavati."""
    second = halved.where("primary_id <> 'vegavati'").select("verse_id", *[F.col(c).alias(f"_{c}") for c in ("status", "primary_id", "match_type")])
    found = whole.join(second, "verse_id", "left")
    none = F.col("primary_id").isNull() | (F.col("status") == "unidentified")
    return found.select("verse_id", *[F.when(none & F.col(f"_{c}").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("status", "primary_id", "match_type")], (none & F.col("_primary_id").isNotNull()).alias("doubled"))


def word_weights(line: Column) -> Column:
    """(word, weights) of a roman line: each syllable belongs to the word that its vowel stands in, with the weight that
    it has in the whole line."""
    words = F.split(F.trim(line), r"\s+")
    sizes = F.transform(words, lambda w: F.size(P.tokens(P.canonical_iast(w))))
    ends = P.prefix_sums(sizes)
    pattern = P.iast_pattern(line)
    return F.transform(words, lambda w, i: F.struct(w.alias("word"), F.substr(pattern, F.get(ends, i) - F.get(sizes, i) + 1, F.get(sizes, i)).alias("weights")))


def source_url(work: Column, urls: dict[str, str]) -> Column:
    """The url of the first title that a work's name contains; null without."""
    out = F.lit(None).cast("string")
    for title, url in reversed(urls.items()):
        out = F.when(F.contains(work, F.lit(title)), url).otherwise(out)
    return out
