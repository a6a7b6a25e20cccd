"""What must hold at scale: memory of dense groups, hot texts and sources, caches of workers."""

import tracemalloc
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import embedding_dedup, language_model, sharding, token_counts
from tessera.llm.ranks import placed


def test_a_dense_tile_takes_no_memory_for_its_pairs():
    """4000 vectors that all link with each other: eight million pairs, added up piece by piece."""
    rng = np.random.default_rng(5)
    x = np.ones((4000, 16), np.float32) + rng.normal(0, 0.01, (4000, 16)).astype(np.float32)
    n = len(x)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, 16), pa.int32()), *(pa.array(np.zeros(n, np.int64)) for _ in range(3)), pa.array(np.arange(n)), pa.ListArray.from_arrays(pa.array(np.arange(0, 16 * n + 1, 16), pa.int32()), pa.array(x.ravel())), pa.array(np.ones(n, np.int64)), pa.array(np.arange(n))],
        names=["dim", "lo", "hi", "block", "id", "v", "m", "node"],
    )
    tracemalloc.start()
    out = list(embedding_dedup._tiles(iter([batch]), 0.9, 11))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in out) == n and set(out[0]["n"].to_pylist()) == {n - 1} and len(set(out[0]["peer"].to_pylist())) == 1
    assert peak < 150e6, f"{peak / 1e6:.0f} MB"


def test_the_sample_of_texts_ignores_copies_and_reads_in_all_partitions(spark, monkeypatch):
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text of copies").otherwise(F.concat(F.lit("text number "), F.col("id").cast("string"))).alias("text")).repartition(16)
    model = open(token_counts.tokenizer_path(), "rb").read()
    monkeypatch.setattr(token_counts, "SAMPLE", 200)
    table = token_counts.frequent_lengths(df, model)
    assert table[" number"] == 1 and table.get(" copies") is None, "the copies of a text count once"


def test_a_second_corpus_of_a_session_has_its_own_counts(spark):
    """Equal sizes and words in equal order, other counts."""
    def scores(*texts):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return {r.doc_id: r.base_score for r in language_model.score(df, F.lit(False)).collect()}

    def want(*texts):
        words = [[*t.split(), ""] for t in texts]
        c = Counter(w for ws in words for w in ws)
        n, v = sum(c.values()), len(c)
        return {k: pytest.approx(sum(log10((c[w] + 1) / (n + v + 1)) for w in ws)) for k, ws in enumerate(words)}

    for texts in (("a a a a a", "b b"), ("a a a a", "b b b")):
        assert scores(*texts) == want(*texts)


def test_many_sources_of_one_row_are_spread(spark):
    """All have the fraction a half; their places come from ranges, and a text of any length has one."""
    rows = [(k, f"text {k}", f"host{k}") for k in range(4000)] + [(5000, "long " * 200_000, "host1")] * 2 + [(None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    out = sharding.interleave(df, 7)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "cell" not in plan
    got = out.collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spread = placed(df.where("doc_id < 4000").select("doc_id", F.lit(0.5).alias("at")), "at", "doc_id", out="place")
    assert [r.place for r in spread.orderBy("doc_id").collect()] == list(range(4000))
    assert spread.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 2500
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_pipeline_stages_on_hard_tables(spark, tmp_path):
    """Empty tables, null and empty texts, repeated rows, ties and a column with a clashing name go through every stage."""
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, rank string"
    texts = ["", None, "one", "two words", "same text again and again", "same text again and again", "x " * 5000]
    rows = [(k, t, None if k == 3 else "en", None if k == 4 else "src1", 1, "clash", "r") for k, t in enumerate(texts)] + [(6, texts[6], "en", "src1", 1, "clash", "r"), (None, "no id", None, None, None, None, None)]
    for name, data in (("hard", rows), ("empty", [])):
        sf = f"{tmp_path}/{name}"
        spark.createDataFrame(data, schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(k, k % 2, 0) for k in range(4)] if data else [], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(1, None), (2, "two words")] if data else [], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        docs = spark.read.parquet(f"{sf}/documents.parquet").drop("shard")
        for k, (_, stage) in enumerate(pipeline.STAGES):
            stage(spark, docs, sf).write.parquet(f"{sf}/out{k}")
            before, docs = docs.columns, spark.read.parquet(f"{sf}/out{k}")
            assert docs.columns == (before if k < 4 else [*before, "shard", "slot"])
            assert data or docs.count() == 0
