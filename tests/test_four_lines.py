"""Verdicts within the row are those of the general plan."""

import random

from pyspark.sql import functions as F

from kavyamill import dims
from kavyamill.operators import meter as M


def test_four_lines_as_identify(spark):
    rng = random.Random(3)
    for n in (8, 11):
        fixed = [r[6] for r in dims.meter_rows() if all(len(p) == n for p in r[6])]
        pairs = [[next(r[5][0] for r in dims.meter_rows() if r[1] == x) for x in u[2:]] for u in dims.UPAJATI]
        verses = []
        for _ in range(120):
            lines = list(rng.choice(fixed)) if fixed else ["".join(rng.choice("LG") for _ in range(n)) for _ in range(4)]
            kind = rng.randrange(4)
            if kind == 1:
                lines = ["".join(rng.choice("LG") for _ in range(n)) for _ in range(4)]
            elif kind == 2 and len(pairs[0][0]) == n or kind == 2 and len(pairs[1][0]) == n:
                lines = [rng.choice(next(p for p in pairs if len(p[0]) == n)) for _ in range(4)]
            if rng.random() < 0.7:
                lines = [p[:-1] + rng.choice("LG") for p in lines]
            if rng.random() < 0.3:
                at = rng.randrange(n)
                lines[1] = lines[1][:at] + "LG"[lines[1][at] == "L"] + lines[1][at + 1 :]
            verses.append("".join(lines))
        rows = list(enumerate(verses))
        units = spark.createDataFrame([(i, k, p[k * n : k * n + n]) for i, p in rows for k in range(4)], "verse_id int, unit_no int, pattern string")
        wanted = {r.verse_id: (r.status, r.primary_id, r.distance) for r in M.identify(units, "classical").collect()}
        frame = spark.createDataFrame([*rows, (900, None), (901, "LG")], "id int, pattern string").withColumn("n", F.lit("odd")).withColumn("status", F.lit("odd"))
        out = M.four_lines(frame, "pattern", n)
        assert out.columns == ["id", "pattern", "n", "status", "primary_id", "distance"]
        found = {r.id: (r.status, r.primary_id, r.distance) for r in out.collect()}
        assert found.pop(900) == found.pop(901) == (None, None, None)
        assert found == wanted, n
