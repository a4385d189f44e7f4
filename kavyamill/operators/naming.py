"""Names resolved by ordered rules: the first key that a name contains, and a recording for each name of a meter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spoken names of the meters that have a recording, in order of precedence, and the recording's key.
RECORDED = (
    ("anuṣṭubh", "anuṣṭubh"), ("anuṣṭubh (śloka)", "anuṣṭubh"), ("anustubh", "anuṣṭubh"), ("śloka", "anuṣṭubh"),
    ("pramāṇikā", "pramāṇikā"), ("pramanika", "pramāṇikā"), ("pañcacāmara", "pramāṇikā"), ("pancacamara", "pramāṇikā"),
    ("indravajrā", "indravajrā"), ("indravajra", "indravajrā"), ("upendravajrā", "upendravajrā"), ("upendravajra", "upendravajrā"),
    ("upajāti", "upajāti"), ("upajati", "upajāti"), ("rathoddhatā", "rathoddhatā"), ("rathoddhata", "rathoddhatā"),
    ("śālinī", "śālinī"), ("shalini", "śālinī"), ("vaṃśastha", "vaṃśastha"), ("vamshastha", "vaṃśastha"),
    ("indravaṃśā", "indravaṃśā"), ("indravamsha", "indravaṃśā"), ("drutavilambita", "drutavilambita"),
    ("bhujaṅgaprayāta", "bhujaṅgaprayāta"), ("bhujangaprayata", "bhujaṅgaprayāta"), ("vasantatilakā", "vasantatilakā"), ("vasantatilaka", "vasantatilakā"),
    ("mālinī", "mālinī"), ("malini", "mālinī"), ("śārdūlavikrīḍita", "śārdūlavikrīḍita"), ("shardulavikridita", "śārdūlavikrīḍita"),
    ("sragdharā", "sragdharā"), ("sragdhara", "sragdharā"),
)
# Meters without a recording, in order, and the one that stands in.
SURROGATES = (
    ("vidyunmālā", "anuṣṭubh"), ("māṇavakākrīḍā", "anuṣṭubh"), ("samānī", "pramāṇikā"), ("pañcacāmara", "pramāṇikā"),
    ("dodhaka", "upajāti"), ("svāgatā", "rathoddhatā"), ("vātormī", "śālinī"), ("bhadrikā", "upajāti"), ("mottanaka", "upajāti"),
    ("toṭaka", "bhujaṅgaprayāta"), ("candravartma", "drutavilambita"), ("jaloddhatagati", "vaṃśastha"), ("tāmarasa", "vaṃśastha"), ("vaiśvadevī", "indravaṃśā"), ("pramitākṣarā", "drutavilambita"),
    ("praharṣiṇī", "vasantatilakā"), ("rucirā", "vasantatilakā"), ("mattamayūra", "vasantatilakā"), ("aparājitā", "vasantatilakā"), ("praharaṇakalitā", "vasantatilakā"),
    ("śaśikalā", "mālinī"), ("maṇiguṇanikara", "mālinī"), ("śikhariṇī", "mālinī"), ("mandākrāntā", "vasantatilakā"), ("hariṇī", "mālinī"), ("pṛthvī", "vasantatilakā"), ("narkuṭaka", "mālinī"),
    ("meghavipruṣitā", "śārdūlavikrīḍita"), ("suvadanā", "sragdharā"), ("aśvalalita", "sragdharā"),
)
# The recording for a line of so many syllables, whether it only stands in, and what stands in for all else.
BY_COUNT = ((8, "anuṣṭubh", False), (11, "upajāti", False), (12, "vaṃśastha", False), (14, "vasantatilakā", False), (15, "mālinī", False), (17, "vasantatilakā", True), (19, "śārdūlavikrīḍita", False), (21, "sragdharā", False))
BY_DEFAULT = "vasantatilakā"
# How a name of the mixed family begins, and the members that make it one of twelve syllables.
MIXED, MIXED_OF_TWELVE = ("upajāti", "upajati"), ("vaṃśastha", "vamsastha", "indravaṃśā", "indravamsha")

#: Longest gram by which keys and names meet.
GRAM = 4
#: Characters of keys up to which their anchors are sent to every task.
SENT = 1 << 20


def _grams(text: Column, size: int) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def first_contained(names: DataFrame, keys: DataFrame, name: str = "name") -> DataFrame:
    """(name, rank, key) for each distinct name that contains a key: the key of the least rank, then the least one.

    keys: key, rank. A key is looked up by one of its grams of up to GRAM characters, that which the fewest other keys
    have; a name by all of its grams of the sizes that keys have. So a name meets only the keys that share a rare gram
    with it, in an equi-join, where a chain of contains() meets them all. Where the keys are few, judged by the sum of
    their lengths, they are broadcast and names are not shuffled before they are reduced to one row each.

    Null names and keys and empty keys match nothing. Repeated names give one row, a repeated key counts with its least
    rank. Case counts.
    """
    n = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    k = keys.where("key is not null and key <> ''").groupBy("key").agg(F.min("rank").alias("rank"))
    size = F.least(F.char_length("key"), F.lit(GRAM))
    sized = F.coalesce(*[F.when(size == g, _grams(F.col("key"), g)) for g in range(1, GRAM + 1)])
    every = k.select("key", "rank", size.alias("size"), F.explode(sized).alias("gram"))
    shared = every.groupBy("gram").agg(F.count("*").alias("sharers"))
    anchors = every.join(shared, "gram").groupBy("key", "rank").agg(F.min_by("gram", F.struct("sharers", "gram")).alias("gram"))
    total, *sizes = k.agg(F.sum(F.char_length("key")), *[F.count_if(size == g) for g in range(1, GRAM + 1)]).first()
    held = [_grams(F.col("name"), g) for g, count in enumerate(sizes, 1) if count]
    grams = n.select("name", F.explode(F.concat(*held) if held else F.array().cast("array<string>")).alias("gram"))
    found = grams.join(F.broadcast(anchors) if (total or 0) <= SENT else anchors, "gram").where(F.contains("name", "key"))
    best = found.groupBy("name").agg(F.min(F.struct("rank", "key")).alias("best"))
    return best.select("name", "best.rank", "best.key")


def plain_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"^\s+|\s+$", "")


def recordings(rows: DataFrame, name: str, syllables: str) -> DataFrame:
    """rows with bank_key, is_surrogate and tier: the recording for a meter's name and the syllables of its lines.

    The first of these that applies: `mixed`, names of the mixed family, of twelve syllables where they name such a
    member or the count says so; `name`, the name is a recorded one; `surrogate`, it is one that another stands in for;
    `within` and `surrogate-within`, the first such key, in the tables' order, that the name contains; `count`; and
    `default`. Case and blanks around a name don't count. Null and blank names go by their count, null counts to the
    default. Rows that repeat repeat; columns of the same names are replaced.
    """
    spark = rows.sparkSession
    plain = "_plain"
    while plain in rows.columns:
        plain += "_"
    rows = rows.drop("bank_key", "is_surrogate", "tier").withColumn(plain, plain_name(F.col(name)))
    tiers = [("within", RECORDED, False), ("surrogate-within", SURROGATES, True)]
    table = [(key, 1000 * t + i, value, stands_in, tier) for t, (tier, pairs, stands_in) in enumerate(tiers) for i, (key, value) in enumerate(pairs)]
    keys = F.broadcast(spark.createDataFrame(table, "key string, rank int, value string, stands_in boolean, of string"))  # two fixed tables
    held = first_contained(rows, keys.select("key", "rank"), plain).join(keys, ["key", "rank"])
    whole = keys.groupBy(F.col("key").alias("name")).agg(F.min_by(F.struct("value", "stands_in", F.when(F.col("stands_in"), "surrogate").otherwise("name").alias("of")), "rank").alias("whole"))
    found = held.join(F.broadcast(whole), "name", "left").select(F.col("name").alias(plain), F.coalesce("whole", F.struct("value", "stands_in", "of")).alias("_found"))
    mixed = F.coalesce(F.startswith(F.col(plain), F.lit(MIXED[0])) | F.startswith(F.col(plain), F.lit(MIXED[1])), F.lit(False))
    twelve = F.col(syllables) == 12
    for term in MIXED_OF_TWELVE:
        twelve = F.coalesce(twelve, F.lit(False)) | F.contains(F.col(plain), F.lit(term))
    made = lambda value, stands_in, tier: F.struct(F.lit(value).alias("value"), F.lit(stands_in).alias("stands_in"), F.lit(tier).alias("of"))
    choice = F.when(mixed & twelve, made("vaṃśastha", False, "mixed")).when(mixed, made("upajāti", False, "mixed")).when(F.col("_found").isNotNull(), F.col("_found"))
    for n, value, stands_in in BY_COUNT:
        choice = choice.when(F.col(syllables) == n, made(value, stands_in, "count"))
    joined = rows.join(found, plain, "left").withColumn("_found", choice.otherwise(made(BY_DEFAULT, True, "default")))
    kept = [c for c in rows.columns if c != plain]
    return joined.select(*kept, F.col("_found.value").alias("bank_key"), F.col("_found.stands_in").alias("is_surrogate"), F.col("_found.of").alias("tier"))
