"""Deterministic stand-ins for annotated images, derived from the driver's tables.

Boxes: an order is an image, its line items are ground truth; a prediction is the same item with class,
place, size and confidence changed by rules on its keys. A mask fills a rectangle a little smaller than its box.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeflow.operators import dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of the images, numbered within their image."""
    raw = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount"]
    order = Window.partitionBy("l_orderkey").orderBy(*raw[1:6])
    # numbered before anything is renamed: so a shuffle carries no column twice, and the planner knows that the rows of an image lie together
    d = table(spark, sf_dir, "lineitem").select(*raw).withColumn("gi", F.row_number().over(order) - 1)
    return d.select(
        F.col("l_orderkey").alias("image"), "gi", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
        F.col("l_quantity").alias("q"), F.round(100 * F.col("l_discount")).alias("disc"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = items(spark, sf_dir)
    x, y = 10 * F.col("q"), 10 * F.col("disc")
    return d.select("image", F.col("gi").alias("gt"), (F.col("n") % 3).alias("cls"), x.alias("x1"), y.alias("y1"), (x + 20 + F.col("p") % 40).alias("x2"), (y + 20 + F.col("s") % 40).alias("y2"), *masks(x, y, x + 20 + F.col("p") % 40 - F.col("p") % 7, y + 20 + F.col("s") % 40))


def masks(x1, y1, x2, y2) -> list:
    return [x1.alias("mx1"), y1.alias("my1"), x2.alias("mx2"), y2.alias("my2")]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = items(spark, sf_dir).where(F.col("p") % 11 != 0)
    x = 10 * F.col("q") + F.col("p") % 7 - 3 + F.when(F.col("s") % 13 == 0, 200).otherwise(0)
    y = 10 * F.col("disc") + F.col("s") % 5 - 2
    w, h = 20 + F.col("p") % 40 + 4 * (F.col("n") % 3), 20 + F.col("s") % 40
    cls = (F.col("n") + F.when(F.col("p") % 10 == 0, 1).otherwise(0)) % 3
    conf = ((31 * F.col("p") + 17 * F.col("s") + 7 * F.col("n")) % 1000) / 1000
    return d.select("image", F.col("gi").alias("pred"), cls.alias("cls"), conf.alias("conf"), x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"), *masks(x + F.col("s") % 3, y, x + w, y + h - F.col("n") % 4))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadrilaterals of the items, as raw point lists; some of them carry defects."""
    t = items(spark, sf_dir)
    x, y = 10 * F.col("q"), 10 * F.col("disc")
    w, h = 20 + F.col("p") % 40, 20 + F.col("s") % 40
    pt = lambda a, b: F.array(a.cast("double"), b.cast("double"))
    quad = F.array(pt(x, y), pt(x + w, y + F.col("p") % 5), pt(x + w, y + h), pt(x, y + h))
    bow = F.array(pt(x, y), pt(x + w, y + h), pt(x + w, y), pt(x, y + h))
    raw = (
        F.when(F.col("p") % 29 == 0, bow).when(F.col("p") % 31 == 0, F.slice(quad, 1, 2)).when(F.col("p") % 37 == 0, F.concat(quad, F.slice(quad, 1, 1)))
        .when(F.col("p") % 41 == 0, F.concat(quad, F.array(F.array(F.lit(float("nan")), F.lit(1.0))))).when(F.col("p") % 47 == 0, F.concat(quad, F.array(F.array(F.lit(1.0))))).otherwise(quad)
    )
    label = F.when(F.col("s") % 47 == 0, "").otherwise(F.concat(F.lit("class"), (F.col("n") % 3).cast("string")))
    kind = F.when(F.col("p") % 43 == 0, "rectangle").otherwise("polygon")
    return t.select("image", "gi", raw.alias("raw"), quad.alias("quad"), label.alias("label"), kind.alias("shape_type"), F.lit(500.0).alias("width"), F.lit(140.0).alias("height"))


def split_of(key: str = "image"):
    """Train for 7 of 10 images, then val and test."""
    r = F.col(key) % 10
    return F.when(r < 7, "train").when(r < 9, "val").otherwise("test")


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.fingerprints(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def prints_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors, and of every fiftieth a copy that differs a little in one component, so that near pairs are there to be found."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    changed = F.transform("embedding", lambda x, i: F.when(i == F.col("vec_id") % 7, x + 0.03125).otherwise(x))
    copies = e.where(F.col("vec_id") % 50 == 0).withColumn("embedding", changed).withColumn("vec_id", F.col("vec_id") + 1_000_000)
    return dedup.fingerprints(e.unionByName(copies), "vec_id", "embedding")
