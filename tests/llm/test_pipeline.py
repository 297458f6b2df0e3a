from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.fixtures import awkward


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert 0.6 * n < out.count() <= n


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    ends = got.groupBy("sequence_id").sum("length").collect()
    assert ends and all(r[1] <= 4096 for r in ends)


def test_awkward_rows_pass_all_stages(spark, sf):
    docs = awkward(spark, False)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count()


def test_empty_table_passes_all_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_clashing_names_and_null_rows(spark, sf):
    """Columns named like those that the stages use, and rows of nothing but nulls, go through unharmed."""
    names = ["task", "root", "row", "rest", "places", "set_key", "kept", "label", "features", "spans", "new_text", "shard"]
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    rows = [(i, f"text number {i} " + " ".join(f"w{i}x{k}" for k in range(30)), *names) for i in range(8)] + [(None, None, *[None] * len(names))] * 2
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", *names]
    assert sorted(map(tuple, docs.collect()), key=repr) == sorted(rows, key=repr)


def test_batches_are_bounded_by_bytes(spark, sf):
    """Also for what runs after a stage returned."""
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("0123456789"), 1000).alias("text"))
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, docs.limit(1), sf)
        assert docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] <= corpus_pipeline.BATCH_BYTES + 100_000
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_small_batches_change_nothing(spark, monkeypatch):
    sf, got = "/root/testdata/sf0.001", []
    for size in (64 << 20, 3000):
        monkeypatch.setattr(corpus_pipeline, "BATCH_BYTES", size)
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.materialise(stage(spark, docs, sf))
        pieces = corpus_pipeline.packing(spark, docs, sf).select("doc_id", "start", "length", "ids_crc32", "doc_tokens")
        got.append((sorted(map(tuple, docs.collect()), key=repr), sorted(map(tuple, pieces.collect()))))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert got[0] == got[1] and got[0][0]
