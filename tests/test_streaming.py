from kavyamill.operators.corpus import client_key, truthy, within_quota
from kavyamill.streaming import state as T


def test_quota_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartitionByRange(6, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = T.file_stream(spark, str(tmp_path / "in"), events.schema, 100)
    T.run_to_end(T.quota_stream(stream, "user_id", "ts", 2), "append", str(tmp_path / "out"), str(tmp_path / "cp"))
    found = {(r.event_id, r.accepted) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    wanted = {(r.event_id, r.accepted) for r in within_quota(events, "user_id", "ts", "event_id", 2).collect()}
    assert found == wanted
    T.run_to_end(T.quota_stream(T.file_stream(spark, str(tmp_path / "in"), events.schema), "user_id", "ts", 2), "append", str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()  # nothing is read twice


def test_latest_and_windows(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = T.latest_stream(T.file_stream(spark, str(tmp_path / "in"), events.schema), "user_id", ["ts", "event_id"], ["value"])
    T.run_to_end(stream, "complete", str(tmp_path / "latest"), str(tmp_path / "cp1"))
    assert spark.table("latest").count() == events.select("user_id").distinct().count()
    windows = T.windowed_counts(T.file_stream(spark, str(tmp_path / "in"), events.schema), "ts", "8 hours", "4 hours", "1 hour")
    T.run_to_end(windows, "complete", str(tmp_path / "win"), str(tmp_path / "cp2"))
    assert spark.table("win").groupBy().sum("n").first()[0] == 2 * events.count()


def test_client_key_and_truthy(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("d", "f, g", "p", " Yes"), ("", "f, g", "p", "0"), (None, None, "p", None), (None, "", None, "TRUE")], "a string, b string, c string, t string")
    found = [tuple(r) for r in df.select(client_key(F.col("a"), F.col("b"), F.col("c")), truthy(F.col("t"))).collect()]
    assert found == [("d", True), ("f", False), ("p", False), ("unknown", True)]
