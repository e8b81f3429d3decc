"""The corpus pipeline: five stages over ``documents``, each one operator of gaugeflow.llm.

toxicity (rejected documents go), near duplicates (one document of each class stays), PII (texts are
sanitised), mixing (rows in the order of the mix), BPE (ids and decoded text). Each stage works on
all rows its predecessor kept; all but the last return the columns of ``documents``. The network is
fitted on the labelled rows among a stage's own input; its labels are not read when it scores.

The mix is an order, and a table has none: the mixing stage deals the rows to files that follow one another in it, and
the last stage, which reads these files, returns each row's file and place (``mix_file``, ``mix_row``). Ordered by both, any
prefix of run()'s rows up to the end of the first source holds the target weights to less than a block.

Behaviour: null and empty texts pass every stage (as one class of duplicates each has one row left); very long texts are read whole; of
repeated rows one stays; an empty table gives an empty result; extra columns, whatever their names, ride along to the last stage.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm import bpe, mixing, neardup, pii, toxicity
from gaugeflow.llm.common import fold
from gaugeflow.session import discard, materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = toxicity.trained(docs, labels, "toxic", fold("doc_id", 5) != 0)
    return toxicity.keep(docs, net)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.dedup(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.ordered(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text, with each row's file and place in it; both are null if ``docs`` is no scan of files."""
    place = [F.element_at(F.split("_metadata.file_path", "/"), -1).alias("mix_file"), F.col("_metadata.row_index").alias("mix_row")]
    try:
        placed = docs.select("doc_id", "text", *place)
    except AnalysisException:
        placed = docs.select("doc_id", "text", F.lit(None).cast("string").alias("mix_file"), F.lit(None).cast("long").alias("mix_row"))
    return bpe.encode(placed, keep=["mix_file", "mix_row"])


STAGES = [("toxicity", drop_toxic), ("near_dup", drop_near_duplicates), ("pii", sanitise), ("mixing", mix), ("bpe", encode)]
#: No SQL: the first stage is a trained network. tests/llm/test_pipeline.py holds the rest against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{name}", wide=True)
            discard(before)
    return docs
