"""What the ten operators share: row identity, hashing of labels and Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of text that a worker holds decoded at a time; a longer text makes a chunk of its own.
CHUNK_CHARS = 1_000_000

_held: dict = {}


def worker_object(key: tuple, make):
    """This worker process's object for ``key``. A worker holds one at a time, so operators that run one after another in it do not add up."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def worker_release() -> None:
    """Drops what an earlier operator left in this worker."""
    _held.clear()


def with_small_batches(spark: SparkSession, rows: int) -> SparkSession:
    """Another session of the same application, with the same settings but Arrow batches of at most ``rows`` rows, for rows that hold a lot. The given session's settings stay as they are."""
    other = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if other.conf.isModifiable(name):
            other.conf.set(name, value)
    other.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return other


def reopened(table: DataFrame, session: SparkSession) -> DataFrame:
    """A materialised table, read in another session."""
    return session.read.schema(table.schema).parquet(table.written_to)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1, ...: names with dots or in odd spelling do not get through the functions that take Arrow batches."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def map_rows(df: DataFrame, run) -> DataFrame:
    """``df`` after ``run`` over its Arrow batches (columns c0, c1, ...), with its own column names and types."""
    plain = numbered(df)
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def chunks(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts as Python strings (null: empty), ``limit`` characters each at most unless one text is longer."""
    for batch in batches:
        sizes = [x or 0 for x in pc.binary_length(batch.column(column)).to_pylist()]
        start = total = 0
        for i, n in enumerate([*sizes, None]):
            if n is None or (total + n > limit and i > start):
                if i > start:
                    part = batch.slice(start, i - start)
                    yield part, [x or "" for x in part.column(column).to_pylist()]
                start, total = i, 0
            total += n or 0


def ids_and_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text) alone, so that extra columns neither travel nor clash."""
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))


def bounded_ids(sizes: DataFrame, rows: int, chars: int) -> DataFrame:
    """doc_id of a bounded sample: of the ``rows`` ids of lowest hash, the first that have ``chars`` characters together (one at least). ``sizes`` has doc_id, h and size, a row a document.

    Ids and sizes alone travel; ``rows`` of them reach one task.
    """
    per = sizes.groupBy("doc_id").agg(F.min("h").alias("h"), F.sum("size").alias("size")).orderBy("h", "doc_id").limit(rows)
    order = Window.orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))).where((F.col("before") == 0) | (F.col("before") + F.col("size") <= chars)).select("doc_id")
