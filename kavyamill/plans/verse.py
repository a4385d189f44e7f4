"""Queries on whole verses and units, over worked cases and over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kavyamill.functions import prosody as P
from kavyamill.operators import verse as V
from kavyamill.plans.prosody import LG
from kavyamill.plans.registry import golden, query, table, values

ANALYSES = [
    ("iast", "sarvasya cāhaṁ hṛdi sanniviṣṭo\nmattaḥ smṛtir jñānam apohanaṁ ca", "iast", "lines", 2, "GGLGGLLGLGG|GGLGGLLGLGL", 35, "", True),
    ("deva", "धर्मक्षेत्रे कुरुक्षेत्रे । समवेता युयुत्सवः ॥ १ ॥", "devanagari", "dandas", 2, "GGGGLGGG|LLGGLGLG", 27, "", True),
    ("digit", "janmādy 2 yat", "iast", "single", 1, "GGG", 6, "unknown-character", False),
    ("mixed", "राम rāma", "mixed", "single", 1, "GL", 3, "mixed-script", False),
    ("none", "123 !", "none", "single", 1, "", 0, "no-letters", False),
    ("ascii", "raama", "iast", "single", 1, "LLL", 3, "ascii-scheme", False),
    ("pluta", "agnā3 i", "iast", "single", 1, "GGL", 6, "pluta", True),
]


@golden(f"SELECT * FROM {values([(i, s, m, n, p, t, d, ok) for i, _, s, m, n, p, t, d, ok in ANALYSES], 'verse_id, script, boundary_mode, padas, patterns, matras, diagnostics, ok')}")
def verse_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.analyze(spark.createDataFrame([x[:2] for x in ANALYSES], "verse_id string, text string"))
    return rows.select("verse_id", "script", "boundary_mode", F.col("totals.padas").alias("padas"), F.array_join(F.transform("padas", lambda p: p["pattern"]), "|").alias("patterns"), F.col("totals.matras").alias("matras"), F.array_join("diagnostics", ",").alias("diagnostics"), "ok")


_ME = [("GGLGGLLGLGG" * 4, "indravajra", 11, 4), ("GGLGGLLGLGL" * 4, "indravajra", 11, 4), ("GGLGGLLGLGGLGLGGLLGLGG" * 2, "upajati", 11, 4), ("L" * 32, "anushtubh", 8, 4), ("G" * 16, "anushtubh_half", 8, 2), ("G" * 7, "unknown", None, None), ("", "unknown", None, None)]


@golden(f"SELECT * FROM {values(_ME, 'pattern, name, pada_length, num_padas')}")
def recitation_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x[0],) for x in _ME], "pattern string").withColumn("m", V.recitation_meter(F.col("pattern"))).select("pattern", "m.name", "m.pada_length", "m.num_padas")


_SUTRA = [(1, "om|,a,ta", "100"), (2, "a,om,tat|", "000"), (3, "a|,om,ta,om|,a", "01110"), (4, "om,ta,om|,om,a", "11100"), (5, "ta,ka", "00")]


@golden(f"SELECT id, mask, positions FROM {values([(1, '100', '-1.-1 0.0 0.1'), (2, '000', '0.0 0.1 1.0'), (3, '01110', '0.0 -1.-1 -1.-1 -1.-1 0.1'), (4, '11100', '-1.-1 -1.-1 -1.-1 0.0 0.1'), (5, '00', '0.0 0.1')], 'id, mask, positions')}")
def sutra_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([x[:2] for x in _SUTRA], "id int, s string")
    syllables = F.transform(F.split("s", ","), lambda x: F.struct(F.replace(x, F.lit("|"), F.lit("")).alias("text"), x.endswith("|").alias("is_pada_final")))
    rows = rows.withColumn("mask", V.sutra_mask(syllables))
    places = F.transform(V.pada_positions(F.col("mask"), F.lit(2)), lambda p: F.concat_ws(".", p["pada_index"], p["pos"]))
    return rows.select("id", "mask", F.array_join(places, " ").alias("positions"))


_CASES = [
    ("onset", "taM ca| brahmaSezI||", "taM ca brah ma Se zI"), ("onset", "sandiSyate", "san diS ya te"), ("onset", "a i t ka", "a it ka"), ("onset", "saMy~ama", "saM y~a ma"),
    ("head", "janmādy", "ja nmādy"), ("head", "’stv", "’stv "), ("head", "chāyā", "chā yā"), ("head", "aṁśa", "aṁ śa"),
    ("yati", "12:sarvasya cāhaṁ hṛdi sanniviṣṭo", None), ("yati", "5:sarvasya cāhaṁ hṛdi sanniviṣṭo", "1"), ("yati", "4:sarvasya cāhaṁ hṛdi", None),
    ("signature", "GGLGGLLGLGG", "indravajrā(11)"), ("signature", "GGG", "(3)"),
    ("line", "GGLGGLLGLGG,GGLGGLLGLGL,GGLGGLLGLGG,GGLGGLLGLGG", "indravajrā"), ("line", "GG,GGLGGLLGLGG,LGLGGLLGLGG,GGLGGLLGLGG,LGLGGLLGLGG", "upajāti (indravajrā–upendravajrā)*"), ("line", "LLLLLLLL,GGGGGGGG", "anuṣṭubh (śloka)"), ("line", "GGG,GGG,GGG,GGG", "unidentified"), ("line", "LGLGGLLGLGLG,GGLGGLLGLGLG,LGLGGLLGLGLG,LGLGGLLGLGLG", "upajāti (vaṁśastha–indravaṁśā)"),
    ("pack", "कमल कमल कमल कमल कमल कमल कमल कमल कमल", "8 1"), ("depth", "क क क ख ग ख ग ख", "3 2"), ("depth", "क ख क ख क ख", "1 3"), ("depth", "क", "1 1"),
    ("kannada", "ರಾಮ ತತ್", "2210111"), ("position", "ab\r\ncd\nef", "3 2"),
    ("kind", "प्रथम अध्याय", "title"), ("kind", "अर्जुन उवाच", "speaker"), ("kind", "ॐ तत्सदिति", "colophon"), ("kind", "धर्मक्षेत्रे", "verse"),
]


@golden(f"SELECT f, x, y FROM {values(_CASES, 'f, x, y')}")
def verse_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([x[:2] for x in _CASES], "f string, x string")
    x = F.col("x")
    head, line, depth, place = V.word_head(x), V.line_identity(F.split(x, ",")), V.repeat_depths(F.split(x, " ")), V.line_column(x, F.lit(8))
    columns = {
        "onset": F.array_join(V.syllables_by_onset(x), " "), "head": F.concat_ws(" ", head["head"], head["tail"]), "yati": V.yati_boundary(F.regexp_extract(x, r"^\d+:(.*)$", 1), F.try_to_number(F.regexp_extract(x, r"^(\d+):", 1), F.lit("99")).cast("int")).cast("string"), "signature": V.label_of(x), "line": F.concat(line["label"], F.when(line["note"].isNotNull(), "*").otherwise("")),
        "pack": F.array_join(F.transform(V.packed_words(x), lambda p: F.size(F.split(p, " ")).cast("string")), " "), "depth": F.concat_ws(" ", depth["mono"], depth["di"]), "kannada": V.kannada_weights(x, F.lit("rAmatat")), "position": F.concat_ws(" ", place["line"], place["column"]), "kind": V.unit_kind(x, F.lit(1), F.lit("1"), F.lit("a.wav")),
    }
    out = F.lit(None).cast("string")
    for name, column in columns.items():
        out = F.when(F.col("f") == name, column).otherwise(out)
    return rows.select("f", "x", out.alias("y"))


_LABELS = [("indravajrā", "triṣṭubh", 11, "identified", "indravajrā (triṣṭubh — 11 akṣara)"), ("anuṣṭubh (śloka)", "anuṣṭubh", 8, "provisional", "anuṣṭubh (śloka) — 8 akṣara — provisional"), ("āryā", None, None, "ambiguous", "āryā — ambiguous"), ("x", None, None, "insufficient-evidence", "x — fragment only"), (None, None, None, "unidentified", "unidentified metre")]


@golden(f"SELECT name, status, label FROM {values([(a, d, e) for a, _, _, d, e in _LABELS], 'name, status, label')}")
def verdict_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([x[:4] for x in _LABELS], "name string, cls string, n int, status string")
    return rows.select("name", "status", V.verdict_label(F.col("name"), F.col("cls"), F.col("n"), F.col("status")).alias("label"))


_BANK = [("Malini", "m.wav"), ("vasantatilaka", "v.wav"), ("_notes", "n.wav"), ("arya", "Giti.wav")]


@golden(f"SELECT meter, wav FROM {values([('MALINI', 'm.wav'), ('giti', 'Giti.wav'), ('arya', 'Giti.wav'), ('_notes', 'v.wav'), ('none', 'v.wav'), (None, 'v.wav')], 'meter, wav')}")
def bank_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("MALINI",), ("giti",), ("arya",), ("_notes",), ("none",), (None,)], "meter string")
    return V.bank_lookup(rows, spark.createDataFrame(_BANK, "meter string, wav string"), "meter", "vasantatilaka")


@query("SELECT doc_id, CAST(len(string_split_regex(text, '\\n')) AS BIGINT) AS lines, CASE WHEN contains(text, chr(10)) THEN 'lines' WHEN contains(text, '|') THEN 'dandas' ELSE 'single' END AS mode FROM documents")
def boundary_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("lines"), V.boundary_mode(F.col("text")).alias("mode"))


_TABLE = " ".join(f"WHEN regexp_full_match(p, '(({'|'.join(x[:-1] for x in patterns)}).){{4}}') THEN '{name}'" for name, patterns in V.RECITATION_METERS)
_LABEL_CASES = " ".join(f"WHEN p = '{p}' THEN '{label}'" for p, label in V.SIGNATURES.items())


@query(f"SELECT doc_id, CASE {_TABLE} WHEN len(p) = 32 THEN 'anushtubh' WHEN len(p) = 16 THEN 'anushtubh_half' ELSE 'other' END AS meter, CASE {_LABEL_CASES} ELSE concat('(', len(p), ')') END AS label FROM (SELECT doc_id, array_to_string({LG}, '') AS p FROM documents)")
def recitation_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reciters' name of every document's whole pattern, and the labeler's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", P.pattern(P.letters(F.col("text"))).alias("p"))
    name = V.recitation_meter(F.col("p"))["name"]
    return docs.select("doc_id", F.when(name == "unknown", "other").otherwise(name).alias("meter"), V.label_of(F.col("p")).alias("label"))


@query(f"SELECT CAST(s AS BIGINT) AS stanza, doc_id, CASE {_TABLE} ELSE 'other' END AS meter FROM (SELECT doc_id, s, array_to_string(w[s * 44 + 1:s * 44 + 44], '') AS p FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) // 44 - 1)) AS s FROM (SELECT doc_id, {LG} AS w FROM documents)))")
def recitation_of_stanzas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reciters' name of each stretch of 44 syllables of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", P.pattern(P.letters(F.col("text"))).alias("p"))
    stanzas = docs.select("doc_id", F.posexplode(F.regexp_extract_all("p", F.lit("(.{44})"), F.lit(1))).alias("stanza", "p"))
    name = V.recitation_meter(F.col("p"))["name"]
    return stanzas.select(F.col("stanza").cast("long").alias("stanza"), "doc_id", F.when(name == "unknown", "other").otherwise(name).alias("meter"))


@query("SELECT conv_id, turn, to_json(struct_pack(role := role, size := length(text))) AS j FROM conversations")
def null_dropping_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A struct as JSON, its null fields left out."""
    s = F.struct("role", F.length("text").alias("size"), F.lit(None).cast("string").alias("note"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(s, {"ignoreNullFields": "true"}).alias("j"))
