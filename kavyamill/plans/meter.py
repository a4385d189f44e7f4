"""Queries on meters: the table itself, matches, ranks and verdicts over well-known verses and generated ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kavyamill import dims
from kavyamill.functions import prosody as P
from kavyamill.operators import meter as M
from kavyamill.plans.registry import golden, query, table, values

# Verses of old texts, a line each.
VERSES = {
    "bg-15-15": ("sarvasya cāhaṁ hṛdi sanniviṣṭo", "mattaḥ smṛtir jñānam apohanaṁ ca", "vedaiś ca sarvair aham eva vedyo", "vedāntakṛd vedavid eva cāham"),
    "bg-2-47": ("karmaṇy evādhikāras te", "mā phaleṣu kadācana", "mā karmaphalahetur bhūr", "mā te saṅgo ’stv akarmaṇi"),
    "sankhya-1": ("duḥkhatrayābhighātāj jijñāsā tadapaghātake hetau", "dṛṣṭe sāpārthā cen naikāntātyantato ’bhāvāt"),
    "gayatri": ("tat savitur vareṇyaṃ", "bhargo devasya dhīmahi", "dhiyo yo naḥ pracodayāt"),
    "meghaduta-1": ("kaścit kāntāvirahaguruṇā svādhikārapramattaḥ śāpenāstaṃgamitamahimā varṣabhogyeṇa bhartuḥ", "yakṣaś cakre janakatanayāsnānapuṇyodakeṣu snigdhacchāyātaruṣu vasatiṃ rāmagiryāśrameṣu"),
}
_MK, _IV, _UV = "GGGGLLLLLGGLGGLGG", "GGLGGLLGLGG", "LGLGGLLGLGG"
#: Verses made of patterns: heavy as kā, light as ka.
MADE = {
    "all-light": ("LLLLLLLL",) * 4,
    "mixed-siblings": (_IV, _IV, _UV, _IV),
    "alternating-siblings": (_IV, _UV, _IV, _UV),
    "one-pada": (_MK,),
    "one-wrong": (_MK, _MK, _MK, "L" + _MK[1:]),
    "jagati-mix": ("LGLGGLLGLGLG", "GGLGGLLGLGLG", "LGLGGLLGLGLG", "LGLGGLLGLGLG"),
    "nothing": ("LGL", "GG"),
}
#: verse, tradition, status, identified, first candidate, match, distance, splits of written lines, ties.
VERDICTS = [
    ("bg-15-15", "auto", "identified", True, "indravajra", "exact", 0, 0, 1),
    ("bg-2-47", "classical", "provisional", False, "anustubh-sloka", "exact", 0, 0, 1),
    ("sankhya-1", "classical", "provisional", False, "arya", "exact", 0, 2, 1),
    ("gayatri", "vedic", "provisional", False, "vedic-gayatri-nicrt-pada-1", "class-compatible", 0, 0, 1),
    ("meghaduta-1", "classical", "provisional", False, "mandakranta", "exact", 0, 2, 1),
    ("all-light", "classical", "provisional", False, "anustubh-sloka", "class-compatible", 8, 0, 1),
    ("mixed-siblings", "classical", "identified", True, "upajati-tristubh", "exact", 0, 0, 1),
    ("alternating-siblings", "classical", "ambiguous", False, "akhyanaki", "exact", 0, 0, 2),
    ("one-pada", "classical", "insufficient-evidence", False, "mandakranta", "partial", 0, 0, 1),
    ("one-wrong", "classical", "unidentified", False, "mandakranta", "near", 1, 0, 1),
    ("jagati-mix", "classical", "provisional", False, "upajati-jagati", "exact", 0, 0, 1),
    ("nothing", "auto", "unidentified", False, None, None, None, None, None),
]


def made_line(pattern: str) -> str:
    return " ".join("kā" if c == "G" else "ka" for c in pattern)


def units(spark: SparkSession) -> DataFrame:
    rows = [(k, i, line) for k, lines in VERSES.items() for i, line in enumerate(lines)]
    rows += [(k, i, made_line(p)) for k, patterns in MADE.items() for i, p in enumerate(patterns)]
    return spark.createDataFrame(rows, "verse_id string, unit_no int, line string").select("verse_id", "unit_no", P.iast_pattern(F.col("line")).alias("pattern"))


def catalog_units(spark: SparkSession) -> DataFrame:
    rows = [(r[1], i, made_line(p)) for r in dims.meter_rows() for i, p in enumerate(r[6])]
    return spark.createDataFrame(rows, "verse_id string, unit_no int, line string").select("verse_id", "unit_no", P.iast_pattern(F.col("line")).alias("pattern"))


@golden(f"SELECT verse_id, tradition, status, identified, primary_id, match_type, CAST(distance AS INTEGER) AS distance, CAST(boundary_transformations AS INTEGER) AS boundary_transformations, CAST(tied AS BIGINT) AS tied FROM {values(VERDICTS, 'verse_id, tradition, status, identified, primary_id, match_type, distance, boundary_transformations, tied')}")
def meter_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([(x[0], x[1]) for x in VERDICTS], "verse_id string, asked string")
    verdicts = M.identify(units(spark).join(F.broadcast(wanted), "verse_id"))
    return verdicts.join(F.broadcast(wanted.withColumnRenamed("asked", "tradition")), "verse_id")


@golden(f"SELECT id, true AS found, id AS first_or_tied FROM {values([(r[1],) for r in dims.meter_rows()], 'id')}")
def catalog_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each meter, written out and scanned again, is among its own exact candidates."""
    found = M.candidates(catalog_units(spark), "classical").where("match_type = 'exact'")
    own = found.where("verse_id = id").select("verse_id", "id")
    every = catalog_units(spark).select("verse_id").distinct()
    return every.join(own, "verse_id", "left").select(F.col("verse_id").alias("id"), F.col("id").isNotNull().alias("found"), F.col("id").alias("first_or_tied"))


@golden("SELECT CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS problem WHERE false")
def catalog_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.catalog_violations(dims.meters(spark))


@golden("SELECT kind, CAST(n AS BIGINT) AS n FROM (VALUES ('sama-vrtta', 94), ('ardhasama-vrtta', 13), ('visama-vrtta', 11), ('dandaka', 10)) AS t(kind, n)")
def catalog_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.meters(spark).groupBy("kind").agg(F.count("*").alias("n"))


def _catalog_values() -> str:
    return values([(r[1], p, len(p)) for r in dims.meter_rows() if r[3] == "sama-vrtta" for p in r[5]], "id, p, n")


from kavyamill.plans.prosody import LG  # noqa: E402

#: Words of a document as lines of eight to twenty-six syllables would be too rare: its first 11 syllables stand for a line.
_LINES = f"SELECT doc_id, unnest(generate_series(0, len(w) // 11 - 1)) AS line, w FROM (SELECT doc_id, {LG} AS w FROM documents)"


def _document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", P.pattern(P.letters(F.col("text"))).alias("p"))
    runs = docs.select("doc_id", F.posexplode(F.regexp_extract_all("p", F.lit("(.{11})"), F.lit(1))).alias("line", "pattern"))
    return runs.withColumn("line", F.col("line").cast("long"))


@query(f"WITH l AS (SELECT doc_id, line, array_to_string(w[line * 11 + 1:line * 11 + 11], '') AS pattern FROM ({_LINES})) SELECT doc_id, CAST(line AS BIGINT) AS line, pattern, c.id AS meter_id FROM l JOIN {_catalog_values().replace('AS t(', 'AS c(')} ON c.n = 11 AND left(l.pattern, 10) = left(c.p, 10)")
def meter_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of 11 syllables of every document that has a meter's pattern, the last syllable free."""
    return M.exact_lookup(_document_lines(spark, sf_dir)).where("meter_id is not null")


def _near_top3(lines: DataFrame) -> DataFrame:
    """(doc_id, line, meter_id, distance) of the three meters nearest to each line of 11, within the row: ten weights are
    the bits of a number, and those that differ are the bits of the numbers' exclusive or."""
    bits = F.conv(F.translate(F.left("pattern", F.lit(10)), "LG", "01"), 2, 10).cast("long")
    of = lambda p: int(p[:10].translate({76: 48, 71: 49}), 2)
    meters = [(r[1], r[5][0]) for r in dims.meter_rows() if r[3] == "sama-vrtta" and len(r[5][0]) == 11]
    every = F.array(*[F.struct(F.bit_count(F.col("bits").bitwiseXOR(F.lit(of(p)))).cast("long").alias("distance"), F.lit(ident).alias("meter_id")) for ident, p in meters])
    best = lines.withColumn("bits", bits).select("doc_id", "line", F.explode(F.slice(F.array_sort(every), 1, 3)).alias("b"))
    return best.select("doc_id", "line", "b.meter_id", "b.distance")


@query(f"WITH l AS (SELECT doc_id, line, array_to_string(w[line * 11 + 1:line * 11 + 11], '') AS pattern FROM ({_LINES})), d AS (SELECT doc_id, line, c.id, CAST(len(list_filter(range(1, 11), lambda i: pattern[i] <> c.p[i])) AS BIGINT) AS distance FROM l JOIN {_catalog_values().replace('AS t(', 'AS c(')} ON c.n = 11) SELECT doc_id, CAST(line AS BIGINT) AS line, id AS meter_id, distance FROM d QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY distance, id) <= 3")
def meter_near_top3_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest meters of every run of 11 syllables of every document, the last syllable free."""
    return _near_top3(_document_lines(spark, sf_dir))


@query(f"WITH l AS (SELECT doc_id, unnest(generate_series(0, len(w) // 8 - 1)) AS pada, w FROM (SELECT doc_id, {LG} AS w FROM documents)), p AS (SELECT doc_id, pada, array_to_string(w[pada * 8 + 1:pada * 8 + 8], '') AS x FROM l) SELECT doc_id, CAST(pada AS BIGINT) AS pada, CASE WHEN pada % 2 = 1 THEN 'even-pāda cadence' WHEN x[5:7] = 'LGG' THEN 'pathyā' WHEN x[2:7] = 'GLGGGG' THEN 'ma-vipulā' WHEN x[2:7] IN ('GLGGLL', 'GGGGLL') THEN 'bha-vipulā' WHEN x[4:7] = 'GLLL' THEN 'na-vipulā' WHEN x[4:7] = 'GGLG' THEN 'ra-vipulā' ELSE 'unclassified odd-pāda cadence' END AS subtype, CAST((x[2:3] = 'LL')::INT + CASE WHEN pada % 2 = 1 THEN (x[2:4] = 'GLG')::INT + (x[5:7] <> 'LGL')::INT ELSE (NOT (x[5:7] = 'LGG' OR x[2:7] IN ('GLGGGG', 'GLGGLL', 'GGGGLL') OR x[4:7] IN ('GLLL', 'GGLG')))::INT END AS BIGINT) AS problems FROM p")
def sloka_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", P.pattern(P.letters(F.col("text"))).alias("p"))
    padas = docs.select("doc_id", F.posexplode(F.regexp_extract_all("p", F.lit("(.{8})"), F.lit(1))).alias("pada", "x"))
    scan = padas.withColumn("s", M.sloka_pada(F.col("x"), F.col("pada") % 2 == 1))
    return scan.select("doc_id", F.col("pada").cast("long").alias("pada"), "s.subtype", F.col("s.problems").cast("long").alias("problems"))


@golden(f"SELECT id, name, CAST(n AS BIGINT) AS n, count_class, symmetry FROM {values([(r[1], r[2], len(r[6][0]) if len(set(map(len, r[6]))) == 1 else None, dims.COUNT_CLASSES[len(r[6][0]) - 1] if len(set(map(len, r[6]))) == 1 and len(r[6][0]) <= 26 else None, {1: 'sama', 2: 'ardhasama', 4: 'viṣama'}[len(r[5])]) for r in dims.meter_rows()], 'id, name, n, count_class, symmetry')}")
def meter_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = F.array(*map(F.lit, dims.COUNT_CLASSES))
    m = dims.meters(spark).withColumn("sizes", F.array_distinct(F.transform("pada_patterns", F.length)))
    n = F.when(F.size("sizes") == 1, F.element_at("sizes", 1))
    symmetry = F.when(F.size("patterns") == 1, "sama").when(F.size("patterns") == 2, "ardhasama").otherwise("viṣama")
    return m.select("id", "name", n.cast("long").alias("n"), F.when(n <= 26, F.get(classes, n - 1)).alias("count_class"), symmetry.alias("symmetry"))


@golden("SELECT CAST(NULL AS VARCHAR) AS verse_id, CAST(NULL AS VARCHAR) AS id WHERE false")
def candidate_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact matches that a second plan finds and the candidates lack: none. The second plan compares the written
    places one by one in exploded rows, not by arrays."""
    rows = catalog_units(spark)
    places = rows.select("verse_id", "unit_no", F.posexplode(F.split("pattern", "")).alias("pos", "w")).where("w <> ''")
    meters = dims.meters(spark).select("id", "terminal_policy", F.posexplode("pada_patterns").alias("unit_no", "p"))
    expected = meters.select("id", "terminal_policy", "unit_no", F.length("p").alias("size"), F.posexplode(F.split("p", "")).alias("pos", "e")).where("e <> ''")
    joined = places.join(F.broadcast(expected), ["unit_no", "pos"])
    free = (F.col("pos") == F.col("size") - 1) & ((F.col("terminal_policy") == "bidirectional") | ((F.col("e") == "G") & (F.col("w") == "L")))
    totals = joined.groupBy("verse_id", "id").agg(F.count("*").alias("same_places"), F.count_if((F.col("w") != F.col("e")) & ~free).alias("wrong"))
    of_verse, of_meter = places.groupBy("verse_id").agg(F.count("*").alias("v")), expected.groupBy("id").agg(F.count("*").alias("m"))
    exact = totals.join(of_verse, "verse_id").join(F.broadcast(of_meter), "id").where("wrong = 0 and same_places = v and same_places = m")
    found = M.candidates(rows, "classical").where("match_type = 'exact'").select("verse_id", "id")
    return exact.select("verse_id", "id").join(found, ["verse_id", "id"], "left_anti")


@query("SELECT doc_id, CAST(NULL AS VARCHAR) AS maker, CAST(NULL AS VARCHAR) AS checker FROM documents WHERE false")
def analysis_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose weights a second scanner disputes: none. It reads each letter as its class alone, and weighs a
    vowel by the classes after it, where the first one cuts tokens and looks at their letters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", P.letters(F.col("text")).alias("s"))
    both = docs.select("doc_id", P.pattern(F.col("s")).alias("maker"), P.class_pattern(F.col("s")).alias("checker"))
    return both.where("maker <> checker")
