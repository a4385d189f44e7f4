"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, CONTAINMENT = 5, 0.8
#: Chance that no band of a window that holds a template meets it.
MISS = 1e-6
MAX_TEMPLATES = 10_000

#: Notices as licensors publish them.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != "")


def _shingles(words: Column) -> Column:
    """Distinct 64-bit hashes of the five-word shingles of an array of at least five words."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1)), lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " "))))


def _signature(shingles: Column, bands: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda b: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, b))))


def shingle_count(words: list[str]) -> int:
    return len({tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)})


def window_of(n_words: int) -> tuple[int, int]:
    """Length and step of the windows for templates of n words: any run of n words lies within one of them."""
    length = 8
    while n_words > length - length // 4 + 1:
        length *= 2
    return length, length // 4


def bands_for(templates: dict[str, list[str]], miss: float = MISS) -> int:
    """Bands of one row each, so many that a window with CONTAINMENT of any template misses it with at most `miss`."""
    least = 1.0
    for words in templates.values():
        n, (length, _) = shingle_count(words), window_of(len(words))
        shared = math.ceil(CONTAINMENT * n)
        least = min(least, shared / (length - SHINGLE + 1 + n - shared))
    return math.ceil(math.log(miss) / math.log(1 - least)) if least < 1 else 1


def anchors(templates: dict[str, list[str]]) -> list[str]:
    """Words such that text without any of them holds less than CONTAINMENT of each template's shingles."""
    out: list[str] = []
    for words in templates.values():
        shingles = {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
        total = len(shingles)
        for word in sorted(set(words), key=lambda x: (x not in out, -len(x), x)):
            if len([s for s in shingles if not set(s) & set(out)]) < CONTAINMENT * total:
                break
            if word not in out:
                out.append(word)
    return sorted(out)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, license_id, containment, n_windows and first_word of each template that a document holds.

    A template is held if one of the overlapping windows has at least CONTAINMENT of its distinct five-word shingles;
    containment is the largest share, n_windows how many windows hold it, first_word where the first of them begins.
    Words are lower-cased runs of letters and digits. Rows with the same doc_id count as one document; null and
    empty texts hold nothing; other columns are ignored. Templates need five words or more, and there may be
    MAX_TEMPLATES of them, which bounds the broadcast.
    """
    spark = docs.sparkSession
    words = {k: template_words(v) for k, v in templates.items()}
    if len(words) > MAX_TEMPLATES or min(map(len, words.values())) < SHINGLE:
        raise ValueError(f"templates: at most {MAX_TEMPLATES}, of {SHINGLE} words or more")
    bands, keys = bands_for(words), anchors(words)
    classes = sorted({window_of(len(w)) for w in words.values()})
    rows = [(k, window_of(len(w))[0], w) for k, w in words.items()]
    known = spark.createDataFrame(rows, "license_id string, length int, words array<string>").withColumn("held", _shingles(F.col("words")))
    lookup = F.broadcast(known.select("license_id", "length", "held", F.posexplode(_signature(F.col("held"), bands)).alias("band", "value")))

    # Only windows with an anchor can hold enough of a template; the first filter spares the others' splitting.
    found = docs.select("doc_id", _words(F.col("text")).alias("w")).where(F.lower("text").rlike("|".join(map(re.escape, keys))))
    found = found.where(F.size("w") >= SHINGLE).withColumn("at", F.filter(F.transform("w", lambda x, i: F.when(x.isin(keys), i)), lambda i: i.isNotNull())).where(F.size("at") > 0)

    def windows(length: int, step: int) -> Column:
        near = lambda p: F.sequence(F.greatest(F.lit(0), F.floor((p - length + step) / step).cast("int")), F.floor(p / step).cast("int"))
        starts = F.array_distinct(F.flatten(F.transform("at", near)))
        cut = F.transform(starts, lambda j: F.struct(F.lit(length).alias("length"), (j * step).alias("start"), F.slice("w", j * step + 1, length).alias("part")))
        return F.filter(cut, lambda x: F.size(x["part"]) >= SHINGLE)

    cut = found.select("doc_id", F.explode(F.concat(*[windows(*c) for c in classes])).alias("x"))
    cut = cut.select("doc_id", "x.length", "x.start", _shingles(F.col("x.part")).alias("shingles"))
    met = cut.select("doc_id", "length", "start", "shingles", F.posexplode(_signature(F.col("shingles"), bands)).alias("band", "value")).join(lookup, ["length", "band", "value"])
    share = F.size(F.array_intersect("shingles", "held")) / F.size("held")
    kept = met.select("doc_id", "license_id", "length", "start", share.alias("share")).where(F.col("share") >= CONTAINMENT)
    once = kept.groupBy("doc_id", "license_id", "length", "start").agg(F.max("share").alias("share"))
    return once.groupBy("doc_id", "license_id").agg(F.max("share").alias("containment"), F.count("*").alias("n_windows"), F.min("start").cast("long").alias("first_word"))
