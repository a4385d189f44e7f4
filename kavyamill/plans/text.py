"""Queries on text: cleaning, scripts, transliteration, sandhi, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kavyamill.functions import prosody as P
from kavyamill.functions import text as X
from kavyamill.plans.registry import golden, query, table, values

#: (function, input, output): worked by hand from the rules.
CASES = [
    ("deva_to_iast", "धर्मक्षेत्रे", "dharmakṣetre"), ("deva_to_iast", "रामः।", "rāmaḥ."), ("deva_to_iast", "सत् अऽपि ॥", "sat a'pi .."), ("deva_to_iast", "संस्कृतम्", "saṃskṛtam"),
    ("iast_to_deva", "dharmakṣetre", "धर्मक्षेत्रे"), ("iast_to_deva", "Aiśvarya auṣadha", "ऐश्वर्य औषध"), ("iast_to_deva", "saṃskṛtam ’pi", "संस्कृतम् ऽपि"),
    ("slp1", "नारायणम्", "nArAyaRam"), ("slp1", "ब्रह्मजिज्ञासा", "brahmajijYAsA"), ("slp1", "सर्वं दुःखम्।", "sarvaM duHKam|"),
    ("visarga_sandhi", "rAmaH api", "rAmo 'pi"), ("visarga_sandhi", "rAmaH gacCati", "rAmo gacCati"), ("visarga_sandhi", "saH gacCati", "sa gacCati"), ("visarga_sandhi", "agniH atra", "agnir atra"), ("visarga_sandhi", "harayaH karoti", "harayaH karoti"), ("visarga_sandhi", "guruH ramate", "gurU ramate"), ("visarga_sandhi", "devAH atra", "devA atra"), ("visarga_sandhi", "rAmaH iti", "rAma iti"), ("visarga_sandhi", "rAmaH", "rAmaH"), ("visarga_sandhi", "kaH aH gaH", "ko 'H gaH"),
    ("visarga_echo", "rAmaH", "rAmaha"), ("visarga_echo", "SrIpatiH", "SrIpatihi"), ("visarga_echo", "guruH eva guruH", "guruH eva guruhu"), ("visarga_echo", "rAma", "rAma"),
    ("phonetic", "रामः करोति", "रामᳵ करोति"), ("phonetic", "रामः पतति", "रामᳶ पतति"), ("phonetic", "रामः च", "रामश् च"), ("phonetic", "संगः ।", "सङ्गः"), ("phonetic", "अहं शिवः", "अहं शिवः"),
    ("strip_punctuation", "गुरु:- इति-वत् ॥ १५ ॥", "गुरुः इतिवत्"), ("strip_numerals", "धर्म ॥ १५ ॥ 7", "धर्म ॥॥ "), ("expand_om", "ॐ तत्", "ओम् तत्"), ("collapse", " अ  ॥ ॥ आ । । ", "अ ॥ आ ।"), ("rewrite_adjacent", "संगः संयोगः अहं", "सङ्गः सँयोगः अहम्"), ("rewrite_adjacent", "अन्तःकरण अन्तःपुर", "अन्तᳵकरण अन्तᳶपुर"),
    ("kannada", "रामः", "ರಾಮಃ"), ("kannada_final", "ಹರಿಃ", "ಹರಿಹಿ"), ("kannada_final", "ರಾಮಃ", "ರಾಮಹ"), ("kannada_final", "ರಾಮಾಃ", "ರಾಮಾಃ"), ("kannada_final", "ಅಹಂ", "ಅಹಮ್"), ("kannada_nasals", "ಸಂಗ ಅಹಂ ಚ ಅಹಂ", "ಸಙ್ಗ ಅಹಞ್ ಚ ಅಹಂ"), ("kannada_satva", "ರಾಮಃ ಚ", "ರಾಮಶ್ಚ"), ("kannada_metathesis", "ಬ್ರಹ್ಮ ವಹ್ನಿ", "ಬ್ರಹ್ಮ ವನ್ಹಿ"), ("kannada_vocalic_l", "ಕೢ", "ಕ್ಲೃ"), ("kannada_before_ksha", "ಆಹುಃ ಕ್ಷೇತ್ರ", "ಆಹುಹು ಕ್ಷೇತ್ರ"),
    ("ends_halant", "तत् ॥", "true"), ("ends_halant", "राम", "false"), ("akshara_count", "धर्मक्षेत्रे ಅಹ", "6"), ("akshara_split", "धर्मः", "ध|र्मः"), ("safe_name", "a b/ç.txt", "a_b__.txt"), ("ascii_fold", "Śrī-kṛṣṇa’s chāyā", "ri krsnas caya"), ("syllable_count", "dharmakṣetre kurukṣetre", "8"), ("script", "x ಕ क", "kannada"), ("script", "abc", "devanagari"), ("script", "𑌅", "grantha"), ("strict", "राम rāma", "mixed"), ("strict", "123", "none"), ("one_verse", "अ ॥ आ ॥", "several verses"), ("one_verse", "अ ।", None), ("aligner", "राम 'ति ॐ १", "rAma ti ॐ"), ("phones", "rAm a", "r A m a"),
]

def functions() -> dict[str, Column]:
    x = F.col("x")
    text = lambda c: c.cast("string")
    return {
        "deva_to_iast": X.deva_to_iast(x), "iast_to_deva": X.iast_to_deva(x), "slp1": X.deva_to_slp1(x), "visarga_sandhi": X.visarga_sandhi(x), "visarga_echo": X.visarga_echo(x), "phonetic": X.phonetic(x), "strip_punctuation": X.strip_punctuation(x), "strip_numerals": X.strip_numerals(x), "expand_om": X.expand_om(x), "collapse": X.collapse(x),
        "rewrite_adjacent": X.rewrite_adjacent(x), "kannada": X.model_text(x), "kannada_final": X.kannada_final(x), "kannada_nasals": X.kannada_nasals(x), "kannada_satva": X.kannada_satva(x), "kannada_metathesis": X.kannada_metathesis(x), "kannada_vocalic_l": X.kannada_vocalic_l(x), "kannada_before_ksha": X.kannada_before_ksha(x), "ends_halant": text(X.ends_halant(x)), "akshara_count": text(P.aksharas(x)),
        "akshara_split": F.array_join(P.akshara_split(x), "|"), "safe_name": X.safe_name(x), "ascii_fold": X.ascii_fold(x), "syllable_count": text(X.syllable_count(x)), "script": X.script_of(x), "strict": X.script_strict(x), "one_verse": X.one_verse_error(x), "aligner": X.aligner_slp1(x), "phones": X.word_phones(x),
    }


@golden(f"SELECT f, x, y FROM {values(CASES, 'f, x, y')}")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text function over cases worked by hand."""
    rows = spark.createDataFrame([(a, b) for a, b, _ in CASES], "f string, x string")
    out = F.lit(None).cast("string")
    for name, column in functions().items():
        out = F.when(F.col("f") == name, column).otherwise(out)
    return rows.select("f", "x", out.alias("y"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[āīūṛṝḷḹṃṁḥṅñṭḍṇśṣĀĪŪṚṜḶḸṂṀḤṄÑṬḌṆŚṢ]') THEN 'iast' ELSE 'unknown' END AS by_share, CASE WHEN regexp_matches(text, '\\p{Latin}') THEN 'iast' ELSE 'none' END AS strict, 'devanagari' AS first_block FROM documents")
def script_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.script_by_share(t).alias("by_share"), X.script_strict(t).alias("strict"), X.script_of(t).alias("first_block"))


@query("WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents), n AS (SELECT doc_id, c, count(*) AS n FROM c GROUP BY ALL), s AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM n) SELECT doc_id, round(-sum(p * log2(p)), 6) AS entropy FROM s GROUP BY doc_id")
def char_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.round(X.entropy(F.col("text")), 6).alias("entropy"))


@query("WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents), n AS (SELECT doc_id, c, count(*) AS n FROM c GROUP BY ALL), s AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM n), e AS (SELECT doc_id, -sum(p * log2(p)) AS h FROM s GROUP BY doc_id) SELECT doc_id, length(text) >= 200 AS long_enough, (length(text) - length(regexp_replace(text, '[a-zA-Z\\s]', '', 'g'))) / length(text) >= 0.7 AS right_letters, h >= 3.0 AS varied FROM documents JOIN e USING (doc_id)")
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long enough, mostly in the wanted letters (here ASCII, as the tables hold no Devanagari), varied enough."""
    t = F.col("text")
    share = F.regexp_count(t, F.lit(r"[a-zA-Z\s]")) / F.length(t)
    return table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", (F.length(t) >= 200).alias("long_enough"), (share >= 0.7).alias("right_letters"), (X.entropy(t) >= 3.0).alias("varied"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[0-9०-९।॥]', ' ', 'g'), '[^\\p{L}\\p{M}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS cleaned FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_for_language(F.col("text")).alias("cleaned"))


@query("SELECT doc_id, regexp_replace(regexp_replace(translate(text, '()\"''“”‘’-', ''), '\\s*[०-९0-9]+\\s*[।॥]+', '॥', 'g'), '[०-९0-9]+', '', 'g') AS stripped FROM documents")
def numeral_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.strip_numerals(X.strip_editorial(F.col("text"))).alias("stripped"))


@query("SELECT conv_id, turn, regexp_matches(lower(text), 'aa|ii|uu|chh|sh|\\.r|r\\^i|~n') AS ascii_scheme FROM conversations")
def ascii_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.ascii_scheme_guard(F.col("text")).alias("ascii_scheme"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[kKgGNcCjJYwWqQRtTdDnpPbBmyrlvSzsh]{2,}')) AS BIGINT) AS clusters, len(regexp_extract_all(text, '[kKgGNcCjJYwWqQRtTdDnpPbBmyrlvSzsh]{2,}')) >= 5 AS conjunct_heavy FROM documents")
def cluster_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_count("text", F.lit("[kKgGNcCjJYwWqQRtTdDnpPbBmyrlvSzsh]{2,}"))
    return table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("clusters"), (n >= 5).alias("conjunct_heavy"))


@query("WITH RECURSIVE p AS (SELECT doc_id, string_split_regex(text, '\\n+') AS parts FROM documents), f AS (SELECT doc_id, parts, 1 AS i, 0 AS chunk, length(parts[1]) AS size FROM p UNION ALL SELECT doc_id, parts, i + 1, chunk + (size + length(parts[i + 1]) > 500)::INT, CASE WHEN size + length(parts[i + 1]) > 500 THEN length(parts[i + 1]) ELSE size + length(parts[i + 1]) END FROM f WHERE i < len(parts)) SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, string_agg(parts[i], ' ' ORDER BY i) AS piece FROM f GROUP BY doc_id, chunk")
def chunk_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed into pieces of up to 500 characters; a longer line is a piece of its own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n+", "\n\n").alias("t"))
    # A short text of several lines is packed as well, so that all texts go one way.
    none = F.array().cast("array<string>")

    def step(state: Column, part: Column) -> Column:
        full = (state["size"] + F.length(part) > 500) & (F.size(state["now"]) > 0)
        done = F.when(full, F.concat(state["done"], F.array(F.array_join(state["now"], " ")))).otherwise(state["done"])
        return F.struct(done.alias("done"), F.when(full, F.array(part)).otherwise(F.concat(state["now"], F.array(part))).alias("now"), F.when(full, F.length(part)).otherwise(state["size"] + F.length(part)).alias("size"))

    start = F.struct(none.alias("done"), none.alias("now"), F.lit(0).alias("size"))
    packed = F.aggregate(F.split("t", "\n\n"), start, step, lambda s: F.concat(s["done"], F.array(F.array_join(s["now"], " "))))
    return docs.select("doc_id", F.posexplode(packed).alias("chunk", "piece")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), "piece")


@query("WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents), s AS (SELECT doc_id, w, i, sum(len(regexp_extract_all(lower(w), '[aeiou]'))) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM w), f AS (SELECT *, min(CASE WHEN s >= 8 THEN i END) OVER (PARTITION BY doc_id) AS stop FROM s) SELECT doc_id, CAST(arg_min(i, struct_pack(d := abs(s - 8), i := i)) AS BIGINT) AS words FROM f WHERE stop IS NULL OR i <= stop GROUP BY doc_id")
def closest_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many first words have the syllable total nearest to eight, looking no further than the first that has eight."""
    words = F.split("text", " ")
    sizes = F.transform(words, lambda w: F.regexp_count(F.lower(w), F.lit("[aeiou]")))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("i"), F.lit(1_000_000).alias("best"), F.lit(0).alias("at"), F.lit(False).alias("stop"))

    def step(s: Column, n: Column) -> Column:
        total, i = s["sum"] + n, s["i"] + 1
        nearer = ~s["stop"] & (F.abs(total - 8) < s["best"])
        return F.struct(total.alias("sum"), i.alias("i"), F.when(nearer, F.abs(total - 8)).otherwise(s["best"]).alias("best"), F.when(nearer, i).otherwise(s["at"]).alias("at"), (s["stop"] | (total >= 8)).alias("stop"))

    return table(spark, sf_dir, "documents").select("doc_id", F.aggregate(sizes, start, step, lambda s: s["at"]).cast("long").alias("words"))


@query("SELECT g.conv_id, g.turn, round_even(CASE WHEN g.text = '' THEN 0 ELSE len(list_filter(string_split(g.text, ''), lambda c: contains(t.text, c))) END / greatest(length(g.text), length(t.text), 1), 3) AS similarity FROM conversations g JOIN conversations t ON g.conv_id = t.conv_id AND g.turn + 1 = t.turn")
def char_overlap_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a guess's characters that its target has, a turn of a conversation being the guess and the next one its
    target; repeats count each time, so it isn't symmetric."""
    turns = table(spark, sf_dir, "conversations")
    targets = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    pairs = turns.select("conv_id", "turn", F.col("text").alias("guess")).join(targets, ["conv_id", "turn"])
    shared = F.when(F.col("guess") == "", 0).otherwise(F.size(F.filter(F.split("guess", ""), lambda c: F.contains(F.col("target"), c))))
    return pairs.select("conv_id", "turn", F.bround(shared / F.greatest(F.length("guess"), F.length("target"), F.lit(1)), 3).alias("similarity"))
