"""Stages of the pipeline where a table has little to say."""

import corpus_pipeline
from wakeline.llm import decontaminate


def test_quality_passes_all_rows_without_labels(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"clean text number {k}", "s") for k in range(8)], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(None, 1), (99, 1), (1, None)], "doc_id bigint, quality int")
    for k, t in enumerate((labels.limit(0), labels)):
        t.write.parquet(str(tmp_path / str(k) / "labels.parquet"))
        out = corpus_pipeline.quality(spark, docs, str(tmp_path / str(k)))
        assert out.count() == 8 and out.columns == docs.columns


def test_items_without_an_id_count(spark, tmp_path):
    item = "the quick brown fox jumps over the lazy dog while rain falls on the hills"
    other = "nine small boats left the old harbour before the morning light came over the water"
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "a clean text of its own"), (3, f"so {other} then")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(None, item), (None, other), (7, other)], "item_id bigint, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    hits = {(r.doc_id, r.item_id, r.score) for r in decontaminate.contaminated(docs, bench).collect()}
    assert hits == {(1, None, 1.0), (3, None, 1.0), (3, 7, 1.0)}
    assert [r.doc_id for r in corpus_pipeline.clean(spark, docs, str(tmp_path)).collect()] == [2]
