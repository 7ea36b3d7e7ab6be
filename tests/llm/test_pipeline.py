"""The corpus pipeline, stage by stage."""

from __future__ import annotations

import corpus_pipeline
from parcelmart.llm import queries


def test_stages_on_the_small_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kinds, before = docs.dtypes, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.dtypes == kinds, name
        assert docs.where("n_chars != length(text)").count() == 0
        now = docs.count()
        assert now < before if name in ("quality", "near_duplicates") else now == before
        before = now
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == before
    assert queries.pipeline(spark, folder).count() == before


def test_extra_columns_nulls_and_no_rows(spark, folder):
    text = " ".join(f"word{i}" for i in range(90))
    rows = [(1, text, "k"), (None, text, None), (2, text + " end", "s"), (3, None, "n"), (4, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, folder)
            assert out.dtypes == docs.dtypes, name
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, frame, folder).collect()
