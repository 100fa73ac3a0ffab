"""The pipeline from its files to its pieces: columns with odd names through the written tables, and what each stage keeps."""

from __future__ import annotations

from collections import defaultdict

import corpus_pipeline

from .helpers import sentences, table


def test_run_gives_the_pieces_of_what_the_stages_keep(spark, tmp_path):
    passage = " ".join(sentences(3, 3000).split()[100:130])
    table(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
    want = sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.select("doc_id").collect())
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r["doc_id"]].append(r)
    assert sorted((k is None, k) for k in pieces) == want
    for own in pieces.values():
        assert sum(r["length"] for r in own) == own[0]["doc_tokens"]


def test_run_without_labels_keeps_clean_documents(spark, tmp_path):
    docs = [(i, sentences(500 + i, 40, 9000), None, "s", 1) for i in range(20)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(20))
