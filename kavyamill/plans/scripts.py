"""Queries that write every readable word of the documents in other scripts and recite it: one row a distinct word.

The oracles cut words into letters and build each form from the list of letters, where the functions replace in strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kavyamill.functions import prosody as P
from kavyamill.functions import text as X
from kavyamill.functions import units as U
from kavyamill.operators import verse as V
from kavyamill.plans.registry import query, words

_CONS = [c for c in X.DEVA_CONSONANTS.values() if c.isascii()]
_VOWS = ["a", "i", "u", "e", "o", "ai", "au"]
_of = lambda table, keys: "".join(next(k for k, v in table.items() if v == x) for x in keys)
_C, _L, _S = _of(X.DEVA_CONSONANTS, _CONS), _of(X.DEVA_VOWELS, _VOWS), _of(X.DEVA_SIGNS, _VOWS[1:])
_SLP = "".join(X.SLP1_CONSONANTS[list(X.DEVA_CONSONANTS.values()).index(x)] for x in _CONS) + "aiueoEO"


def _written(letters: str) -> str:
    """In DuckDB: Devanagari of a list of roman letters."""
    return f"""array_to_string(list_transform({letters}, lambda x, i: CASE WHEN list_contains({_CONS}, x) THEN substring('{_C}', list_position({_CONS}, x), 1) || CASE WHEN i < len({letters}) AND list_contains({_VOWS}, {letters}[i + 1]) THEN '' ELSE '्' END
        WHEN i > 1 AND list_contains({_CONS}, {letters}[i - 1]) THEN CASE WHEN x = 'a' THEN '' ELSE substring('{_S}', list_position({_VOWS}, x) - 1, 1) END ELSE substring('{_L}', list_position({_VOWS}, x), 1) END), '')"""


_CUT = "'kh|gh|ch|jh|th|dh|ph|bh|ai|au|[a-z]'"
_WORDS = f"""d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
t AS (SELECT word, regexp_extract_all(word, {_CUT}) AS t FROM d WHERE regexp_matches(word, '[aeiou]') AND NOT regexp_matches(word, '[fqwxz]')),
w AS (SELECT word, t, {_written("t")} AS deva, array_to_string(list_transform(t, lambda x: substring('{_SLP}', list_position({_CONS + _VOWS}, x), 1)), '') AS slp1, list_filter(range(1, len(t) + 1), lambda i: list_contains({_VOWS}, t[i])) AS places FROM t),
s AS (SELECT *, regexp_extract_all(slp1, '[aiueoEO][^aiueoEO]*') AS tokens, regexp_extract_all(slp1, '[^aiueoEO]*[aiueoEO]') AS open, regexp_extract(slp1, '[^aiueoEO]*$') AS rest FROM w)"""
_SHIFTED = "list_transform(string_split({0}, ''), lambda x: CASE WHEN unicode(x) BETWEEN 2304 AND 2431 AND x NOT IN ('।', '॥', 'ॐ') THEN chr(unicode(x) + {1}) ELSE x END)"
_KANNADA = "array_to_string(" + _SHIFTED.format("{0}", 0x380) + ", '')"
_WEIGHTS = "array_to_string(list_transform(tokens, lambda x, i: CASE WHEN contains('eoEO', x[1]) OR len(x) > 2 OR (i = len(tokens) AND len(x) > 1) THEN 'G' ELSE 'L' END), '')"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = words(spark, sf_dir).where("word rlike '[aeiou]' and not word rlike '[fqwxz]'").withColumn("deva", X.iast_to_deva(F.col("word")))
    return rows.withColumn("slp1", X.deva_to_slp1(F.col("deva")))


@query(f"""WITH {_WORDS},
p AS (SELECT *, list_concat(regexp_extract_all(word, '[^aeiou]*(?:ai|au|[aeiou])'), list_filter([regexp_extract(word, '[^aeiou]+$')], lambda x: x <> '')) AS pieces FROM w)
SELECT word, deva, word AS iast, slp1, {_KANNADA.format('deva')} AS kannada, array_to_string({_SHIFTED.format('deva', 0x300)}, '') AS telugu, CAST(len(places) AS BIGINT) AS aksharas, array_to_string(list_transform(pieces, lambda y: array_to_string(list_transform(regexp_extract_all(y, {_CUT}), lambda x: x), '.')), '|') AS split, list_contains({_CONS}, t[-1]) AS halant,
CAST(len(places) AS BIGINT) AS counted, replace(word, 'ch', 'c') AS folded, array_to_string(string_split(slp1, ''), ' ') AS phones, slp1 || CASE WHEN list_contains({_VOWS}, t[-1]) THEN 'h' || right(slp1, 1) ELSE 'H' END AS echo, regexp_matches(slp1, '^[Szsh]') AS fricative, 'devanagari' AS script, 'devanagari' AS share, 'devanagari' AS strict, deva || '#' || deva AS studio, deva AS from_kannada, slp1 AS from_telugu FROM p""")
def word_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every readable word in Devanagari, back in roman letters, in one letter a sound, in Kannada and Telugu, and what is counted there."""
    x, slp1, deva = F.col("word"), F.col("slp1"), F.col("deva")
    dotted = F.array_join(F.transform(P.akshara_split(deva), lambda y: F.array_join(F.regexp_extract_all(X.deva_to_iast(y), F.lit(f"({_CUT[1:-1]})"), F.lit(1)), ".")), "|")
    return _words(spark, sf_dir).select(
        "word", "deva", X.deva_to_iast(deva).alias("iast"), "slp1", X.deva_to_kannada(deva).alias("kannada"), U.displayed(deva, "telugu").alias("telugu"), P.aksharas(deva).cast("long").alias("aksharas"), dotted.alias("split"), X.ends_halant(F.concat(deva, F.lit(" ॥"))).alias("halant"),
        X.syllable_count(x).cast("long").alias("counted"), X.ascii_fold(x).alias("folded"), X.word_phones(slp1).alias("phones"), X.visarga_echo(F.concat(slp1, F.lit("H"))).alias("echo"), U.fricative_onset(slp1).alias("fricative"), X.script_of(deva).alias("script"), X.script_by_share(F.concat(deva, F.lit(" a"))).alias("share"), X.script_strict(deva).alias("strict"), F.array_join(U.studio_lines(F.concat(x, F.lit(" ॥ 12 ॥ "), x)), "#").alias("studio"),
        U.in_devanagari(X.deva_to_kannada(deva)).alias("from_kannada"), X.deva_to_slp1(U.in_devanagari(U.displayed(deva, "telugu"))).alias("from_telugu"),
    )


def _nasals(text: str, blank: str, rows: tuple[tuple[str, str], ...]) -> str:
    """In DuckDB: anusvaras of text as the nasal of the row that follows."""
    for row, nasal in rows:
        text = f"regexp_replace({text}, 'ं({blank}[{row}])', '{nasal}\\1', 'g')"
    return text


_NUMBERED = "'ॐ ' || deva || 'ः ' || deva || 'ं ' || deva || ':- (' || deva || ') ॥ १२ ॥ ॥' || deva || ' । । '"
_JOINED = "deva || 'ः' || deva || 'ं' || deva || 'ं'"
_QUIET = "[\\p{Nd}।॥|/\\\\—–\"''“”‘’„«»‹›*•·().,;!?\\x{200C}\\x{200D}-]"
_STRIPPED = f"trim(regexp_replace(regexp_replace(replace(replace(n, ':-', 'ः'), ':', 'ः'), '{_QUIET}', '', 'g'), '\\s+', ' ', 'g'))"
_TURNS = (("कखगघ", "ङ्"), ("चछजझ", "ञ्"), ("टठडढ", "ण्"), ("तथदध", "न्"), ("पफबभ", "म्"))
_BEFORE_SOUNDS = _nasals("regexp_replace(regexp_replace({0}, 'ः([कख])', 'ᳵ\\1', 'g'), 'ः([पफ])', 'ᳶ\\1', 'g')", "", (("कखगघङ", "ङ्"), ("चछजझञ", "ञ्"), ("टठडढण", "ण्"), ("तथदधन", "न्"), ("पफबभम", "म्")))
_ADJACENT = f"regexp_replace(replace({_BEFORE_SOUNDS}, 'ंय', 'ँय'), 'ं($|[ \\t\\n।॥])', 'म्\\1', 'g')"
_COLLAPSED = "trim(regexp_replace(regexp_replace(regexp_replace({0}, '\\s+', ' ', 'g'), '॥(\\s*॥)+', '॥', 'g'), '।(\\s*।)+', '।', 'g'))"
_NUMBERLESS = "regexp_replace(regexp_replace({0}, '\\s*[०-९0-9]+\\s*[।॥]+', '॥', 'g'), '[०-९0-9]+', '', 'g')"
_EDITED = "translate({0}, '()\"''“”‘’-‌', '')"
_PHONETIC = "regexp_replace(regexp_replace(q, 'ः(\\s*[कख])', 'ᳵ\\1', 'g'), 'ः(\\s*[पफ])', 'ᳶ\\1', 'g')"
for _row, _sibilant in (("शचछ", "श्"), ("षटठ", "ष्"), ("सतथ", "स्")):
    _PHONETIC = f"regexp_replace({_PHONETIC}, 'ः(\\s*[{_row}])', '{_sibilant}\\1', 'g')"


@query(f"""WITH {_WORDS}, n AS (SELECT *, {_NUMBERED} AS n, {_JOINED} AS j FROM s), q AS (SELECT *, {_STRIPPED} AS q FROM n)
SELECT word, q AS stripped, {_EDITED.format('n')} AS edited, {_NUMBERLESS.format('n')} AS numberless, replace(n, 'ॐ', 'ओम्') AS om, {_COLLAPSED.format('n')} AS collapsed, {_ADJACENT.format('j')} AS adjacent, {_nasals(_PHONETIC, chr(92) + 's*', _TURNS)} AS phonetic,
{_COLLAPSED.format(_ADJACENT.format("replace(" + _NUMBERLESS.format(_EDITED.format('n')) + ", 'ॐ', 'ओम्')"))} AS normal, {_KANNADA.format("replace(q, 'ॐ ', '')")} AS model, 'several verses' AS several, CASE WHEN 25 * len(places) > 100 THEN 'too long' END AS single FROM q""")
def recited_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every readable word between the marks of a recited verse: punctuation, numbers, om, visargas and anusvaras rewritten."""
    deva = F.col("deva")
    numbered = F.concat(F.lit("ॐ "), deva, F.lit("ः "), deva, F.lit("ं "), deva, F.lit(":- ("), deva, F.lit(") ॥ १२ ॥ ॥"), deva, F.lit(" । । "))
    rows = _words(spark, sf_dir).select("word", "deva", numbered.alias("n"), F.concat(deva, F.lit("ः"), deva, F.lit("ं"), deva, F.lit("ं")).alias("j"))
    n, j = F.col("n"), F.col("j")
    return rows.select("word", X.strip_punctuation(n).alias("stripped"), X.strip_editorial(n).alias("edited"), X.strip_numerals(n).alias("numberless"), X.expand_om(n).alias("om"), X.collapse(n).alias("collapsed"), X.rewrite_adjacent(j).alias("adjacent"), X.phonetic(n).alias("phonetic"), X.normalize_recitation(n).alias("normal"), X.model_text(F.replace(n, F.lit("ॐ "), F.lit(""))).alias("model"), X.one_verse_error(n).alias("several"), X.one_verse_error(F.concat(F.repeat(deva, F.lit(25)), F.lit(" ।।"))).alias("single"))


_TURNED = "k || 'ಂ ' || k || 'ಂ'"
for _row, _nasal in (("ಕಖಗಘಙ", "ಙ್"), ("ಚಛಜಝಞ", "ಞ್"), ("ಟಠಡಢಣ", "ಣ್"), ("ತಥದಧನ", "ನ್")):
    _TURNED = f"regexp_replace({_TURNED}, 'ಂ( *[{_row}])', '{_nasal}\\1', 'g')"
_JOINING = "k || 'ಃ ' || k"
for _row, _sibilant in (("ಚಛ", "ಶ್"), ("ಟಠ", "ಷ್"), ("ತಥ", "ಸ್")):
    _JOINING = f"regexp_replace({_JOINING}, 'ಃ *([{_row}])', '{_sibilant}\\1', 'g')"
_LONG_SIGNS = "ೇೈೋೌ"


@query(f"""WITH {_WORDS}, k AS (SELECT *, {_KANNADA.format('deva')} AS k FROM s), e AS (SELECT *, right(k, 1) AS e FROM k)
SELECT word, CASE WHEN e IN ('ಿ', 'ು') THEN k || 'ಹ' || e WHEN contains('{_LONG_SIGNS}', e) THEN k || 'ಃ' ELSE k || 'ಹ' END AS final, k || 'ಮ್' AS final_m, regexp_replace({_TURNED}, 'ಂ( *[^ ])', 'ಮ್\\1', 'g') AS nasals, {_JOINING} AS satva, replace(replace(k, 'ಹ್ಣ', 'ಣ್ಹ'), 'ಹ್ನ', 'ನ್ಹ') AS metathesis, CASE WHEN e IN ('ಿ', 'ು') THEN k || 'ಹ' || e WHEN contains('{_LONG_SIGNS}', e) THEN k || 'ಃ' ELSE k || 'ಹ' END || ' ಕ್ಷ' AS before_ksha,
k || 'ಕ್ಲೃ' AS vocalic, CASE WHEN regexp_matches(word, '[aeiou]$') AND NOT regexp_matches(word, '[aeiou][aeiou]') THEN len(k) END AS size FROM e""")
def kannada_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every readable word in Kannada with a visarga or an anusvara after it, as it is recited."""
    rows = _words(spark, sf_dir).withColumn("k", X.deva_to_kannada(F.col("deva")))
    k, visarga, anusvara = F.col("k"), F.lit("ಃ"), F.lit("ಂ")
    plain = F.col("word").rlike("[aeiou]$") & ~F.col("word").rlike("[aeiou][aeiou]")
    return rows.select("word", X.kannada_final(F.concat(k, visarga)).alias("final"), X.kannada_final(F.concat(k, anusvara)).alias("final_m"), X.kannada_nasals(F.concat(k, anusvara, F.lit(" "), k, anusvara)).alias("nasals"), X.kannada_satva(F.concat(k, visarga, F.lit(" "), k)).alias("satva"), X.kannada_metathesis(k).alias("metathesis"), X.kannada_before_ksha(F.concat(k, visarga, F.lit(" ಕ್ಷ"))).alias("before_ksha"), X.kannada_vocalic_l(F.concat(k, F.lit("ಕೢ"))).alias("vocalic"), F.when(plain, F.char_length(V.kannada_weights(k, F.col("slp1")))).cast("long").alias("size"))


_NEXT = "slp1[1]"
_LAST = "right(slp1, 1)"


@query(f"""WITH {_WORDS}, b AS (SELECT *, list_transform(open, lambda x: left(x, len(x) - 1)) AS onsets, list_transform(open, lambda x: right(x, 1)) AS vowels FROM s)
SELECT word, {_WEIGHTS} AS pattern, array_to_string(list_transform(open, lambda x, i: CASE WHEN i = len(open) THEN x || rest ELSE x END), '|') AS syllables, array_to_string(list_transform(range(1, len(open) + 1), lambda i: CASE WHEN i = 1 THEN onsets[1] ELSE right(onsets[i], 1) END || vowels[i] || CASE WHEN i = len(open) THEN rest ELSE left(onsets[i + 1], greatest(len(onsets[i + 1]) - 1, 0)) END), ' ') AS by_onset,
array_to_string(t[:places[1]], '') AS head, array_to_string(t[places[1] + 1:], '') AS tail, trim(regexp_replace(translate({_WEIGHTS}, 'GL', '—◡'), '(.{{3}})', '\\1 ', 'g')) || '*' AS template,
array_to_string(list_transform(range(1, len(tokens) + 1), lambda i: vowels[i] || CASE WHEN contains('eoEO', vowels[i]) THEN 'long_vowel' WHEN len(tokens[i]) > 2 THEN 'cluster' WHEN i = len(tokens) THEN 'pada_final_anceps' ELSE '-' END), ' ') AS causes,
CASE WHEN {_NEXT} = 'r' THEN left(slp1, len(slp1) - 1) || translate({_LAST}, 'aiu', 'AIU') WHEN slp1 = 'sa' AND {_NEXT} <> 'a' THEN slp1 WHEN NOT contains('aAiIuUfFxXeEoOgGjJqQdDbBNYRnmyrlvh', {_NEXT}) THEN slp1 || 'H' WHEN {_LAST} = 'a' AND NOT contains('iueoEO', {_NEXT}) THEN left(slp1, len(slp1) - 1) || 'o' WHEN {_LAST} = 'a' THEN slp1 WHEN contains('iueoEO', {_LAST}) THEN slp1 || 'r' ELSE slp1 || 'H' END || ' ' || CASE WHEN {_LAST} = 'a' AND {_NEXT} = 'a' THEN '''' || slp1[2:] ELSE slp1 END AS sandhi,
CASE WHEN len(open) = 2 THEN 0 END AS yati, nullif(array_to_string(list_transform(regexp_extract_all(word, '[ymtrjbns]'), lambda x: CASE x WHEN 'y' THEN 'LGG' WHEN 'm' THEN 'GGG' WHEN 't' THEN 'GGL' WHEN 'r' THEN 'GLG' WHEN 'j' THEN 'LGL' WHEN 'b' THEN 'GLL' WHEN 'n' THEN 'LLL' ELSE 'LLG' END), ''), '') AS feet, CAST(ceil(30.0 / greatest(1, floor(24 / len(places)))) AS BIGINT) AS packs FROM b""")
def scanned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every readable word scanned: weights, syllables by two rules, head, template, causes, sandhi with itself, caesura, feet."""
    x, slp1 = F.col("word"), F.col("slp1")
    pattern, head = P.iast_pattern(x), V.word_head(x)
    causes = F.transform(P.tagged_syllables(slp1), lambda s: F.concat(s["vowel"], F.coalesce(s["cause"], F.lit("-"))))
    feet = F.regexp_replace(x, "[^ymtrjbns]", "")
    twice = F.concat(x, F.lit(" "), x)
    packs = V.packed_words(F.array_join(F.array_repeat(F.col("deva"), F.lit(30)), " "))
    return _words(spark, sf_dir).select(
        "word", pattern.alias("pattern"), F.array_join(P.syllable_texts(slp1), "|").alias("syllables"), F.array_join(V.syllables_by_onset(slp1), " ").alias("by_onset"), head["head"].alias("head"), head["tail"].alias("tail"), P.template(pattern).alias("template"), F.array_join(causes, " ").alias("causes"),
        X.visarga_sandhi(F.concat(slp1, F.lit("H "), slp1)).alias("sandhi"), V.yati_boundary(twice, F.lit(2)).alias("yati"), P.expand_feet(feet).alias("feet"), F.size(packs).cast("long").alias("packs"),
    )
