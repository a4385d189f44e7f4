import json
import struct

import numpy as np
from pyspark.sql import functions as F

from kavyamill.sources import files as S


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_json_scans(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "t": "x"}, {"id": 2}]')
    assert rows(S.json_array(spark, str(tmp_path / "a.json"), "id int, t string")) == [(1, "x"), (2, None)]
    (tmp_path / "m.json").write_text('{"f.wav": {"excluded": true, "reason": "hum"}, "_note": null}')
    assert rows(S.json_map(spark, str(tmp_path / "m.json"), "struct<excluded:boolean,reason:string>")) == [("f.wav", True, "hum")]
    (tmp_path / "broken.json").write_text("{")
    assert rows(S.json_map(spark, str(tmp_path / "broken.json"), "struct<excluded:boolean>")) == []
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert rows(S.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").where("a is not null")) == [(1,), (2,)]
    (tmp_path / "u.json").write_text(json.dumps({"total_dur": 9.5, "units": [{"fn": "a", "v": 1, "p": "title", "start": 0, "end": 2, "nchars": 3}]}))
    assert rows(S.align_units(spark, str(tmp_path / "u.json")).select("total_dur", "at", "fn", "end")) == [(9.5, 0, "a", 2.0)]


def test_csv_scans(spark, tmp_path):
    (tmp_path / "1.csv").write_text("path|dur\na|1.5\nb|oops\n")
    (tmp_path / "2.csv").write_text("path|dur\nc|2\n")
    found = S.tagged_union(spark, {1: str(tmp_path / "1.csv"), 2: str(tmp_path / "2.csv")}, "chapter", {"dur": "double"})
    assert rows(found) == [("a", 1.5, 1), ("b", None, 1), ("c", 2.0, 2)]


def test_text_tree_and_grid(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.txt").write_bytes(b"ab\xff")
    (tmp_path / "y.txt").write_text("ok")
    (tmp_path / "z.md").write_text("no")
    found = rows(S.text_tree(spark, str(tmp_path)).select(F.regexp_extract("path", "([^/]+)$", 1), "text", "was_broken"))
    assert found == [("x.txt", "ab�", True), ("y.txt", "ok", False)]
    grid = 'item [1]: name = "words" xmin = 0 xmax = 1 text = "w"\n item [2]: name = "phones"\n xmin = 0 xmax = 0.5 text = "a" xmin = 0.5\nxmax = 0.7 text = "" xmin = 0.7 xmax = 1 text = "b"'
    (tmp_path / "g.TextGrid").write_text(grid)
    assert rows(S.text_grid(spark, str(tmp_path / "g.TextGrid")).select("at", "start", "end", "label")) == [(0, 0.0, 0.5, "a"), (2, 0.7, 1.0, "b")]


def test_wav_and_existence(spark, tmp_path):
    data = b"\0" * 48000
    (tmp_path / "a.wav").write_bytes(b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 24000, 48000, 2, 16) + b"data" + struct.pack("<I", len(data)) + data)
    listing = spark.read.format("binaryFile").load(str(tmp_path / "*.wav"))
    assert rows(S.wav_header(listing).select("channels", "rate", "bits", "seconds")) == [(1, 24000, 16, 1.0)]
    clips = spark.createDataFrame([("a.wav",), ("b.wav",)], "name string")
    assert rows(S.existing(clips, listing, "name")) == [("a.wav",)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "a", "x")], "i int, name string, note string")
    S.write_json_array(df, str(tmp_path / "arr"), "i")
    text = "".join(p.read_text() for p in (tmp_path / "arr").glob("part-*"))
    assert json.loads(text) == [{"i": 1, "name": "a", "note": "x"}, {"i": 2, "name": "b"}]
    S.write_dual(df, ["i", "name"], str(tmp_path / "flat"), str(tmp_path / "full"))
    assert rows(S.pipe_csv(spark, str(tmp_path / "flat"), {"i": "int"})) == [(1, "a"), (2, "b")]
    assert spark.read.json(str(tmp_path / "full")).count() == 2
    S.write_lines(df, "name", str(tmp_path / "lines"))
    assert rows(spark.read.text(str(tmp_path / "lines"))) == [("a",), ("b",)]
    S.write_by(df, "name", str(tmp_path / "by"))
    assert {p.name for p in (tmp_path / "by").iterdir() if p.is_dir()} == {"name=a", "name=b"}
    S.write_rotated(df.coalesce(1), str(tmp_path / "rot"), 1)
    assert len(list((tmp_path / "rot").glob("*.parquet"))) == 2
    assert rows(S.not_yet_written(df.select("i"), df.where("i = 1"), "i")) == [(2,)]
    assert df.select(S.packaged_path(F.col("i"), F.col("name")).alias("p")).orderBy("p").first()[0] == "ch01_a"


def test_npy_vectors(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array([3, 4, 5], np.int32))
    np.save(tmp_path / "b.npy", np.zeros((2, 2)))
    np.save(tmp_path / "c.npy", np.array([], np.int64))
    (tmp_path / "d.npy").write_bytes(b"not one")
    found = S.npy_vectors(spark.read.format("binaryFile").load(str(tmp_path)))
    assert rows(found.select(F.regexp_extract("path", "([^/]+)$", 1), "values", "total")) == [("a.npy", [3, 4, 5], 12), ("b.npy", None, None), ("c.npy", [], 0), ("d.npy", None, None)]
