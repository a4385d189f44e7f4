"""Queries on units: digits, schemes, labels, durations, checks of two counts, forged catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kavyamill import dims
from kavyamill.functions import prosody as P
from kavyamill.functions import text as X
from kavyamill.functions import units as U
from kavyamill.operators import meter as M
from kavyamill.operators import timeline as T
from kavyamill.plans.prosody import LG
from kavyamill.plans.registry import golden, query, table, values

#: (function, text, result), the expected values of the query below.
CASES = [
    ("digits", "nārada3 || 12 ||", "pluta verse-number verse-number"), ("digits", "देवदत्त३ ॥ १५ ॥", "pluta verse-number verse-number"), ("digits", "a 3 b7", "invalid invalid"), ("digits", "क्३", "invalid"), ("digits", "none", ""),
    ("deva", "राम", "राम"), ("deva", "rāma", "राम"), ("deva", "kRRiShNa", "कृष्ण"), ("deva", "shrii gaNesha", "श्री गणेश"), ("deva", "chhandas", "छन्दस्"), ("kannada", "रामः ।", "ರಾಮಃ ।"), ("telugu", "धर्म", "ధర్మ"), ("devanagari", "धर्म", "धर्म"),
    ("studio", "1.2 rāmaḥ | sītā (3)", "रामः#सीता"), ("studio", "धर्म ॥ १५ ॥\nकर्म", "धर्म#कर्म"), ("studio", " ", ""), ("fricative", "Siva", "true"), ("fricative", "rAma", "false"), ("fricative", "", "false"),
]


@golden(f"SELECT f, x, y FROM {values(CASES, 'f, x, y')}")
def unit_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, out = F.col("x"), F.lit(None).cast("string")
    found = {"digits": F.array_join(U.digit_kinds(x), " "), "deva": U.to_devanagari(x), "kannada": U.displayed(x, "kannada"), "telugu": U.displayed(x, "telugu"), "devanagari": U.displayed(x, "devanagari"), "studio": F.array_join(U.studio_lines(x), "#"), "fricative": U.fricative_onset(x).cast("string")}
    for name, column in found.items():
        out = F.when(F.col("f") == name, column).otherwise(out)
    return spark.createDataFrame([c[:2] for c in CASES], "f string, x string").select("f", "x", out.alias("y"))


@query(f"WITH n AS (SELECT doc_id, len({LG}) AS n FROM documents) SELECT doc_id, CASE WHEN n IN (8, 16, 32) THEN 'anuṣṭubh (śloka)' WHEN n IN (11, 22, 23, 44, 45) THEN 'triṣṭubh / upajāti' ELSE 'chandas (' || n || ' akṣaras)' END AS label FROM n")
def unit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as units that no detector has named, labelled by their syllables."""
    n = F.size(P.tokens(P.letters(F.col("text"))))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).select("doc_id", U.unit_label(U.first_known(F.lit(None).cast("string"), F.lit("")), F.col("n")).alias("label"))


_STATED = "len(regexp_extract_all(replace(replace(replace(replace(replace(replace(lower(text), 'śh', 'ś'), 'ṣh', 'ṣ'), 'ch', 'c'), 'ṛi', 'ṛ'), 'ai', 'E'), 'au', 'O'), '[aāiīuūṛṝḷeoEO]'))"


@query(f"WITH d AS (SELECT len({LG}) - {_STATED} AS diff FROM documents WHERE text IS NOT NULL) SELECT CAST(diff AS BIGINT) AS diff, CAST(count(*) AS BIGINT) AS n, diff = 0 AS same, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM d GROUP BY diff")
def match_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far two ways to count a text's syllables are apart: how often each difference comes, and its share."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select((F.size(P.tokens(P.letters(F.col("text")))) - X.syllable_count(F.col("text"))).cast("long").alias("diff"))
    counts = docs.groupBy("diff").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select("diff", "n", (F.col("diff") == 0).alias("same"), F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("WITH w AS (SELECT user_id, count(*) AS n, sum(value) AS total FROM events GROUP BY user_id) SELECT user_id, CASE WHEN total > 0 THEN round(5.0 + n * total, 4) END AS budget, list_resize([CAST(n AS DOUBLE)], CAST(1 + n % 3 AS BIGINT), 2.0::DOUBLE) AS fitted, [greatest(total, 2.0) / 2, greatest(total, 2.0) / 2, greatest(n, 1.0)] AS spread FROM w")
def unit_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets, padded vectors and even shares of each user's sums, added in the order of the files' rows."""
    events = table(spark, sf_dir, "events").select("user_id", "value", "_metadata.file_path", "_metadata.row_index")
    sums = T.ordered_totals(events, ["user_id"], ["file_path", "row_index"], "value")
    return sums.select(
        "user_id",
        F.round(U.duration_budget(F.lit(5.0), F.col("n"), F.col("total")), 4).alias("budget"),
        U.fitted(F.array(F.col("n").cast("double")), (1 + F.col("n") % 3).cast("int")).alias("fitted"),
        U.spread(F.array("total", F.col("n").cast("double")), F.array(F.lit(2), F.lit(1))).alias("spread"),
    )


#: Forged rows of the catalogue, each wrong in a way of its own, and the problems that the check must name.
FORGED = [("Bad Id", "id"), ("forged-forms", "forms"), ("forged-alphabet", "alphabet"), ("forged-alphabet", "feet"), ("forged-feet", "feet"), ("forged-yati", "yati"), ("forged-late-yati", "yati"), ("forged-twin", "duplicate id"), ("forged-copy", "duplicate form")]


@golden(f"SELECT id, problem FROM {values(FORGED, 'id, problem')}")
def catalog_forgeries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole catalogue and forged rows: the check names what is wrong with these, and nothing else of theirs."""
    base = dims.meters(spark)
    row = base.where("kind = 'sama-vrtta' and yati is null").orderBy("ord").limit(1)

    def forged(name: str, code: str, yati: str = "cast(null as array<int>)", pattern: str | None = None, forms: int = 1) -> DataFrame:
        p = pattern or dims.expand_feet(code)
        return row.withColumns({"id": F.lit(name), "feet": F.array(*[F.lit(code)] * forms), "patterns": F.array(*[F.lit(p)] * forms), "yati": F.expr(yati)})

    odd = ["mmmmmmmmL", "mmmmmmmmG", "mmmmmmmy", "mmmmmmmr", "mmmmmmms", "mmmmmmmt", "mmmmmmmj"]
    rows = [
        forged("Bad Id", odd[0]), forged("forged-forms", odd[1], forms=2), forged("forged-alphabet", odd[2], pattern=dims.expand_feet(odd[2])[:-1] + "X"), forged("forged-feet", odd[3], pattern=dims.expand_feet(odd[3])[:-1] + "L"),
        forged("forged-yati", odd[4], "array(9, 4)"), forged("forged-late-yati", odd[5], "array(400)"), forged("forged-twin", odd[6]), forged("forged-twin", odd[6] + "G"),
        row.withColumn("id", F.lit("forged-copy")),
    ]
    for x in rows:
        base = base.unionByName(x)
    return M.catalog_violations(base).where(F.col("id").isin(*{x for x, _ in FORGED})).distinct()
