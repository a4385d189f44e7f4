"""Queries on syllables and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kavyamill.functions import prosody as P
from kavyamill.plans.registry import golden, query, table, values

V, LONG = P.VOWELS, P.LONG
#: In DuckDB: weight of a token x.
WEIGHT = f"CASE WHEN x[1] IN ({', '.join(repr(c) for c in LONG)}) OR regexp_matches(x[2:], '[MH~]') OR length(x) >= 3 THEN 'G' ELSE 'L' END"
LG = f"list_transform(regexp_extract_all(regexp_replace(text, '[^\\p{{L}}~]', '', 'g'), '[{V}][^{V}]*'), lambda x: {WEIGHT})"

LINES = [(1, "yat sūrayaḥ"), (2, "naimiṣe"), (3, "satyaṁ paraṁ dhīmahi"), (4, "tejo-vāri-mṛdāṁ"), (5, "taẖ karoti"), (6, "janmādy 2"), (7, "sarvasya cāhaṁ hṛdi sanniviṣṭo"), (8, "mattaḥ smṛtir jñānam apohanaṁ ca"), (9, "tat"), (10, ""), (11, "duḥkhatrayābhighātāj jijñāsā tadapaghātake hetau")]
SCANS = [(1, "GGLG"), (2, "GLG"), (3, "GGLGGLL"), (4, "GGGLLG"), (5, "GLGL"), (6, None), (7, "GGLGGLLGLGG"), (8, "GGLGGLLGLGL"), (9, "G"), (10, ""), (11, "GGLGLGGGGGLLLGLGGG")]
SLP1 = [(1, "taM ca| brahmaSezI||"), (2, "om|| ekam||"), (3, "nArAyaRam"), (4, "brahmajijYAsA"), (5, "tat ca sandiSyate"), (6, "'pi ca y~ ta|a"), (7, "")]


@query(f"SELECT doc_id, array_to_string({LG}, '') AS pattern, CAST(len({LG}) AS BIGINT) AS n FROM documents")
def lg_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", P.weights(P.letters(F.col("text"))).alias("w"))
    return docs.select("doc_id", F.array_join("w", "").alias("pattern"), F.size("w").cast("long").alias("n"))


@query(f"WITH w AS (SELECT lang, {LG} AS w FROM documents) SELECT lang, CAST(count(*) AS BIGINT) AS verses, CAST(sum(len(w)) AS BIGINT) AS syllables, CAST(sum(len(list_filter(w, lambda x: x = 'L'))) AS BIGINT) AS laghu, CAST(sum(len(list_filter(w, lambda x: x = 'G'))) AS BIGINT) AS guru, CAST(sum(len(w) + len(list_filter(w, lambda x: x = 'G'))) AS BIGINT) AS matras FROM w GROUP BY lang")
def lg_totals_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", P.pattern(P.letters(F.col("text"))).alias("p"))
    light = F.length(F.translate("p", "G", ""))
    return docs.groupBy("lang").agg(F.count("*").alias("verses"), F.sum(F.length("p")).alias("syllables"), F.sum(light).alias("laghu"), F.sum(F.length("p") - light).alias("guru"), F.sum(P.matras(F.col("p"))).alias("matras"))


@query(f"WITH w AS (SELECT doc_id, {LG} AS w FROM documents) SELECT doc_id, CASE WHEN len(w) = 0 THEN '' ELSE array_to_string(w[:len(w) - 1], '') || 'G' END AS pattern FROM w")
def lg_final_guru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", P.pattern(P.letters(F.col("text")), "guru").alias("pattern"))


@query(f"WITH w AS (SELECT doc_id, unnest({LG}) AS w, generate_subscripts({LG}, 1) - 1 AS i FROM documents) SELECT doc_id, CAST(i AS BIGINT) AS idx, CAST(i // 8 AS BIGINT) AS pada, CAST(i % 8 AS BIGINT) AS pos, w AS weight, i = max(i) OVER (PARTITION BY doc_id) AS is_last, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS next_weight FROM w")
def syllable_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every syllable of every document with its places and the weight after it.

    Each element of the exploded array holds a weight and the next, so nothing names the whole text once a syllable;
    an outer explode keeps the optimiser from deriving a filter that would scan each text a second time.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", P.pattern(P.letters(F.col("text"))).alias("p"))
    rows = docs.select("doc_id", F.posexplode_outer(F.regexp_extract_all("p", F.lit("(?=(.{1,2}))"), F.lit(1))).alias("i", "x")).where("i is not null")
    following = F.substring("x", 2, 1)
    return rows.select("doc_id", F.col("i").cast("long").alias("idx"), F.floor(F.col("i") / 8).alias("pada"), (F.col("i") % 8).cast("long").alias("pos"), F.left("x", F.lit(1)).alias("weight"), (following == "").alias("is_last"), F.nullif(following, F.lit("")).alias("next_weight"))


@query(f"WITH w AS (SELECT doc_id, len({LG}) AS n FROM documents), p AS (SELECT doc_id, n, unnest(generate_series(0, n - 1)) AS i FROM w), q AS (SELECT doc_id, n, i, least(11, n - i // 11 * 11) AS plen FROM p) SELECT doc_id, CAST(i AS BIGINT) AS idx, CAST(i // 11 AS BIGINT) AS pada_idx, CAST(i % 11 AS BIGINT) AS pos, round_even((i % 11)::DOUBLE / greatest(1, plen - 1), 3) AS pos_norm, (i % 11 + 1) IN (4, 7) AS yati_end FROM q")
def pada_positions_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(P.tokens(P.letters(F.col("text")))).alias("n"))
    rows = docs.select("doc_id", "n", F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1))).alias("i"))
    length = F.least(F.lit(11), F.col("n") - F.floor(F.col("i") / 11) * 11)
    return rows.select("doc_id", F.col("i").cast("long").alias("idx"), F.floor(F.col("i") / 11).alias("pada_idx"), (F.col("i") % 11).cast("long").alias("pos"), F.bround((F.col("i") % 11) / F.greatest(F.lit(1), length - 1), 3).alias("pos_norm"), (F.col("i") % 11 + 1).isin(4, 7).alias("yati_end"))


@golden(f"SELECT id, pattern FROM {values(SCANS, 'id, pattern')}")
def iast_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(LINES, "id int, line string").select("id", P.iast_pattern(F.col("line")).alias("pattern"))


@golden(f"SELECT id, parts, unknown FROM {values([(1, 'ya|tsU|ra|yaH', ''), (2, 'nE|mi|ze', ''), (3, 'sa|tyaM|pa|raM|DI|ma|hi', ''), (4, 'te|jo|vA|ri|mf|dAM', ''), (5, 'taH|ka|ro|ti', ''), (6, 'ja|nmAdy2', '2'), (9, 'tat', ''), (10, '', '')], 'id, parts, unknown')}")
def iast_syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.createDataFrame([x for x in LINES if x[0] not in (7, 8, 11)], "id int, line string").withColumn("c", P.canonical_iast(F.col("line")))
    return lines.select("id", F.array_join(P.syllable_texts(F.col("c")), "|").alias("parts"), P.unknown_characters(F.col("c")).alias("unknown"))


@golden(f"SELECT id, CAST(pos AS BIGINT) AS pos, vowel, weight, cause, is_pada_final FROM {values([(1, 0, 'a', 'G', 'anusvara', False), (1, 1, 'a', 'G', 'pada_final_anceps', True), (1, 2, 'a', 'G', 'cluster', False), (1, 3, 'a', 'L', None, False), (1, 4, 'e', 'G', 'long_vowel', False), (1, 5, 'I', 'G', 'long_vowel', True), (2, 0, 'o', 'G', 'long_vowel', True), (2, 1, 'e', 'G', 'long_vowel', False), (2, 2, 'a', 'G', 'pada_final_anceps', True), (3, 0, 'A', 'G', 'long_vowel', False), (3, 1, 'A', 'G', 'long_vowel', False), (3, 2, 'a', 'L', None, False), (3, 3, 'a', 'G', 'pada_final_anceps', True), (4, 0, 'a', 'G', 'cluster', False), (4, 1, 'a', 'L', None, False), (4, 2, 'i', 'G', 'cluster', False), (4, 3, 'A', 'G', 'long_vowel', False), (4, 4, 'A', 'G', 'long_vowel', True), (5, 0, 'a', 'G', 'cluster', False), (5, 1, 'a', 'L', None, False), (5, 2, 'a', 'G', 'cluster', False), (5, 3, 'i', 'G', 'cluster', False), (5, 4, 'a', 'L', None, False), (5, 5, 'e', 'G', 'long_vowel', True), (6, 0, 'i', 'L', None, False), (6, 1, 'a', 'G', 'cluster', False), (6, 2, 'a', 'G', 'pada_final_anceps', True), (6, 3, 'a', 'G', 'pada_final_anceps', True)], 'id, pos, vowel, weight, cause, is_pada_final')}")
def slp1_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(SLP1, "id int, line string").select("id", F.posexplode(P.tagged_syllables(F.col("line"))).alias("pos", "s"))
    return rows.select("id", F.col("pos").cast("long").alias("pos"), "s.vowel", "s.weight", "s.cause", "s.is_pada_final")


@golden(f"SELECT code, pattern FROM {values([('mbnttGG', 'GGGGLLLLLGGLGGLGG'), ('t t-j_G·G', 'GGLGGLLGLGG'), ('LLbbr', 'LLGLLGLLGLG'), ('xq', None), ('', None)], 'code, pattern')}")
def gana_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("mbnttGG",), ("t t-j_G·G",), ("LLbbr",), ("xq",), ("",)]
    return spark.createDataFrame(rows, "code string").select("code", P.expand_feet(F.col("code")).alias("pattern"))


@golden(f"SELECT pattern, template FROM {values([('GGGLLGLGLLLGGGLGGLG', '——— ◡◡— ◡—◡ ◡◡— ‖ ——◡ ——◡ —*'), ('LLLGLLGLLGLG', '◡◡◡ —◡◡ —◡◡ —◡—*')], 'pattern, template')}")
def meter_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("GGGLLGLGLLLGGGLGGLG", [12]), ("LLLGLLGLLGLG", None)]
    return spark.createDataFrame(rows, "pattern string, yati array<int>").select("pattern", P.template(F.col("pattern"), F.col("yati")).alias("template"))


@query(f"WITH w AS (SELECT doc_id, {LG} AS w FROM documents), s AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM w), m AS (SELECT doc_id, sum(CASE w WHEN 'G' THEN 2 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS m FROM s) SELECT doc_id, CAST(count(*) FILTER (WHERE m % 12 = 0) AS BIGINT) AS boundaries, CAST(max(m) AS BIGINT) AS matras FROM m GROUP BY doc_id")
def matra_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the running mātrā count falls on a multiple of twelve."""
    docs = table(spark, sf_dir, "documents").select("doc_id", P.weights(P.letters(F.col("text"))).alias("w")).select("doc_id", "w")
    step = lambda s, w: F.struct((s["m"] + F.when(w == "G", 2).otherwise(1)).alias("m"), (s["n"] + ((s["m"] + F.when(w == "G", 2).otherwise(1)) % 12 == 0).cast("long")).alias("n"))
    folded = docs.select("doc_id", F.size("w").alias("size"), F.aggregate("w", F.struct(F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("n")), step).alias("s"))
    return folded.where("size > 0").select("doc_id", F.col("s.n").alias("boundaries"), F.col("s.m").alias("matras"))


@query("WITH a AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents), r AS (SELECT *, sum(CASE WHEN p IS DISTINCT FROM w THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM a)), n AS (SELECT doc_id, g, count(*) AS n FROM r GROUP BY ALL) SELECT doc_id, CAST(max(n) AS BIGINT) AS mono FROM n GROUP BY doc_id")
def run_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of one word."""
    words = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.split("text", " ").alias("words"))

    def step(state, word):
        run = F.when(word.eqNullSafe(state["last"]), state["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(word.alias("last"), run.alias("run"), F.greatest(state["most"], run).alias("most"))

    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("most"))
    return words.select("doc_id", F.aggregate("words", start, step, lambda s: s["most"]).alias("mono"))
