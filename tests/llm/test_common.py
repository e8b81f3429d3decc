"""Shared helpers: chunks of texts, names that do not clash, the fold of labels, the worker's single object."""

import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from gaugeflow.llm import common
from gaugeflow.session import materialise


def test_chunks_lose_nothing_and_stay_small():
    texts = ["a" * n for n in (0, 5, 3, 20, 1, 1)] + [None, "bb"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["doc_id", "text"])
    parts = list(common.chunks(iter([batch, batch.slice(0, 0)]), limit=8))
    assert [t for _, ts in parts for t in ts] == [t or "" for t in texts]
    assert [i for part, _ in parts for i in part.column(0).to_pylist()] == list(range(8))
    assert all(sum(map(len, ts)) <= 8 or len(ts) == 1 for _, ts in parts)


def test_names_and_folds(spark):
    d = spark.createDataFrame([(7, 1), (None, 2)], "doc_id long, __X int")
    assert common.fresh(d, "__x") == "__x_" and common.fresh(d, "y") == "y"
    assert [r[0] for r in d.orderBy("__X").select(common.fold("doc_id", 5)).collect()] == [zlib.crc32(b"7") % 5, 0]


def test_worker_holds_one_object():
    made = []
    make = lambda k: common.worker_object((k,), lambda: made.append(k) or k)
    assert [make("a"), make("a"), make("b"), make("a")] == ["a", "a", "b", "a"] and made == ["a", "b", "a"]
    common.worker_release()
    make("a")
    assert made[-1] == "a" and len(made) == 4


def test_materialised_tables_keep_schema_and_rows(spark):
    d = spark.range(10).withColumn("v", F.when(F.col("id") > 3, F.array("id")))
    out = materialise(d, "test")
    assert out.dtypes == d.dtypes and sorted(map(str, out.collect())) == sorted(map(str, d.collect()))
    empty = materialise(d.limit(0), "test")
    assert empty.count() == 0 and empty.columns == d.columns
