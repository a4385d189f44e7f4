"""The stages on a table of their own kinds of rows, and the whole on the small test table."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes, texts = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = texts
        texts = stage(spark, before, sf).cache()
        assert texts.columns == docs.columns, name
        sizes.append(texts.count())
        assert texts.join(before, "doc_id", "left_anti").count() == 0, name
        if name == "quality":
            good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").join(docs, "doc_id", "left_semi")
            assert good.join(texts, "doc_id", "left_anti").count() <= 0.05 * good.count()
        if name == "near_copies":
            assert texts.groupBy("text").count().where("count > 1").count() == 0
    assert sizes[0] > sizes[1] > sizes[3] and sizes == sorted(sizes, reverse=True)
    rows = corpus_pipeline.run(spark, sf)
    assert rows.count() == sizes[-1] and rows.where(F.col("n_tokens") <= 0).count() == 0


def test_empty_and_repeated(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = docs.limit(5)
    assert corpus_pipeline.near_copies(spark, some.union(some), sf).count() <= 5
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0


def test_odd_rows_and_clashing_columns(spark, sf):
    """Nulls, blanks, repeated rows, ties, a text of a megabyte, and columns with the names that stages use within."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    kind = docs.schema["n_chars"].dataType
    base = docs.where("n_chars > 300").first()
    long = "\n".join(f"{base.text.split()[i % 40]} line number {i} of a long text" for i in range(30000))
    odd = [(None, base.text, "en", "s", 1), (900001, None, None, None, None), (900002, "", "en", "s", 0), (900003, " \n ", "en", "s", 3), (900004, long, "en", "s", len(long)), (base.doc_id, base.text, base.lang, base.source, base.n_chars)]
    odd += [(900005, base.text, "en", "s", base.n_chars)] * 2
    table = docs.union(spark.createDataFrame(odd, docs.schema))
    names = ["_gone", "_gone_id", "_log_weight", "label", "key", "class_id", "line", "removed"]
    table = table.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)]).repartition(3)
    texts = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, texts, sf)
        assert out.columns == table.columns and out.schema["n_chars"].dataType == kind, name
        texts = out.cache()
        values = texts.select(*names).distinct().collect()
        assert [tuple(r) for r in values] == [tuple(range(len(names)))], name
    kept = [r.doc_id for r in texts.select("doc_id").collect()]
    assert not {900001, 900002, 900003} & set(kept) and kept.count(900005) + kept.count(base.doc_id) <= 2
    rows = corpus_pipeline.tokens(spark, table, sf)
    assert rows.count() == table.count() and rows.where("doc_id = 900001").first().n_tokens == 0
