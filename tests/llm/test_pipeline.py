"""The pipeline's stages keep the documents' columns, and their decisions take effect."""

from __future__ import annotations

import corpus_pipeline
from barloom.llm import quality_fm, simhash, tokens, toxicity_crf
from barloom.llm.common import CACHE_ENTRIES

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert 0 < docs.count() <= kept
            kept = docs.count()
            if k == 2:
                assert simhash.near_duplicates(docs).select("component_id").distinct().count() == kept
    assert docs.select("doc_id").distinct().count() == kept


def test_word_caches_stay_small(monkeypatch):
    words = [f"wort{k}" for k in range(550_000)]
    monkeypatch.setattr(quality_fm, "_words", {})
    chain = toxicity_crf.Chain({"wort1": 2.0})
    encoder = tokens.PieceEncoder(tokens.vocabulary_path(), CACHE_ENTRIES)
    for at in range(0, len(words), 50_000):
        part = words[at : at + 50_000]
        for w in part:
            quality_fm.bucket(w), chain.weight(w)
        encoder.encode(" ".join(part))
        assert max(map(len, (quality_fm._words, chain.cache, encoder, encoder.words))) <= 200_000
    fresh = tokens.PieceEncoder(tokens.vocabulary_path())
    assert [encoder[w] for w in words[:50]] == [fresh[w] for w in words[:50]] and chain.weight("wort1") == 2.0


def test_stages_send_small_batches(spark):
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        spark.conf.unset(batch)
        stage(spark, docs, SF)
        assert int(spark.conf.get(batch)) <= 2_000, name
    spark.conf.unset(batch)
