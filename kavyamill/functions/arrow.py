"""What has no built-in expression: Unicode composition, sequence similarity. Arrow batches, never rows."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Composed form; null stays null."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(ArrayType(StructType([StructField("ch", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])))
def nfc_spans(text: pd.Series) -> pd.Series:
    """Each character of the composed form with the source characters that it comes from; a base and the marks after
    it are composed together, so all of them share one span."""

    def spans(t: str | None) -> list[dict] | None:
        if t is None:
            return None
        out, start = [], 0
        for end in range(1, len(t) + 1):
            if end == len(t) or not unicodedata.combining(t[end]):
                out += [{"ch": c, "start": start, "end": end} for c in unicodedata.normalize("NFC", t[start:end])]
                start = end
        return out

    return text.map(spans)


@F.pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Twice the matching blocks' length over both lengths; 1 for two empty texts, null with a null."""
    return pd.Series([None if a is None or b is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)], dtype=float)


def tail_check(heard: Column, wanted: Column, next_word: Column) -> Column:
    """truncated below a similarity of 0.40, bleed if the next unit's word is heard, else ok."""
    return F.when(sequence_ratio(heard, wanted) < 0.40, "truncated").when((next_word != "") & F.contains(heard, next_word) & ~F.contains(wanted, next_word), "bleed").otherwise("ok")


def deva_clusters(text: Column) -> Column:
    """Written clusters of Devanagari: consonants joined by viramas, a vowel sign, marks; a final half consonant is one
    of its own, and what is no letter is left out."""
    return F.regexp_extract_all(text, F.lit("((?:[क-ह]़?्)*[क-ह]़?(?:[ा-ौॢॣ])?[ंःँ]?(?!्)|[अ-औॠॡ][ंःँ]?|[क-ह]़?्)"), F.lit(1))


def faded(samples: Column, n_in: int, n_out: int) -> Column:
    """A linear ramp over the first samples and half a cosine over the last ones; ramps longer than the clip are left out."""
    n = F.size(samples)

    def level(x: Column, i: Column) -> Column:
        up = F.when((n > n_in) & (i < n_in), i / max(1, n_in - 1)).otherwise(1.0)
        at = i - (n - n_out)
        down = F.when((n > n_out) & (at >= 0), F.cos(at * F.pi() / max(1, n_out - 1)) * 0.5 + 0.5).otherwise(1.0)
        return x * up * down

    return F.transform(samples, level)
