"""The network is fitted in a task; the driver's memory holds neither its texts nor its arrays."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugeflow.llm import toxicity
from gaugeflow.llm.common import fold

SF = "/root/testdata/sf0.01"


def test_toxicity_is_fitted_outside_the_driver(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    learned = fold("doc_id", 5) != 0
    rows = toxicity.training_sample(docs, labels, "toxic", learned)
    fit, driver = toxicity.fit, os.getpid()
    local = fit(rows)

    def elsewhere(rows):
        assert os.getpid() != driver
        return fit(rows)

    monkeypatch.setattr(toxicity, "fit", elsewhere)
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in toxicity.keep(docs, local).collect())
    monkeypatch.undo()
    net = toxicity.trained(docs, labels, "toxic", learned)
    assert net.words == local.words
    texts = [t for t, _ in rows]
    assert toxicity.Scorer(net).scores(texts) == pytest.approx(toxicity.Scorer(local).scores(texts), abs=1e-3)


def test_toxicity_trained_without_rows_or_with_one_label(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(12)], "doc_id long, toxic int")
    assert toxicity.trained(docs.limit(0), labels, "toxic", F.lit(True)).constant == 0.0
    assert toxicity.trained(docs, labels.limit(0), "toxic", F.lit(True)).constant == 0.0
    assert toxicity.trained(docs, labels, "toxic", F.lit(True)).constant == 1.0
