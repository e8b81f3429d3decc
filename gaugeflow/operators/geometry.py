"""Polygons: cleaning, area, canonical keys, issues, normalised coordinates, label lines, rasters and mask IoU.

A polygon is an array of (x, y) structs, raw ones an array of arrays of doubles that may be malformed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.functions.exprs import finite

POINTS = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def next_point(p: Column, i: Column) -> Column:
    return F.get(p, F.pmod(i + 1, F.size(p)))


def area(p: Column) -> Column:
    """Shoelace area; 0 for fewer than three points."""
    cross = F.transform(p, lambda a, i: a["x"] * next_point(p, i)["y"] - next_point(p, i)["x"] * a["y"])
    return F.when(F.size(p) < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2)


def bounds(p: Column) -> Column:
    """Struct of x1, y1, x2, y2."""
    xs, ys = F.transform(p, lambda a: a["x"]), F.transform(p, lambda a: a["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def aspect(box: Column) -> Column:
    """Width by height; null without height."""
    return F.try_divide(box["x2"] - box["x1"], box["y2"] - box["y1"])


def well_formed(q: Column) -> Column:
    return q.isNotNull() & (F.size(q) == 2) & F.forall(q, finite)


def structured(q: Column) -> Column:
    """Whether an entry is a point at all: two coordinates at least, finite or not."""
    return q.isNotNull() & (F.size(q) >= 2) & F.get(q, F.lit(0)).isNotNull() & F.get(q, F.lit(1)).isNotNull()


def changes(p: Column) -> Column:
    """Points that differ from the one before."""
    return F.filter(p, lambda a, i: (i == 0) | ~a.eqNullSafe(F.get(p, i - 1)))


def opened(p: Column) -> Column:
    """Without a last point equal to the first."""
    return F.when((F.size(p) > 1) & (F.get(p, F.lit(0)) == F.get(p, F.size(p) - 1)), F.slice(p, 1, F.size(p) - 1)).otherwise(p)


def without_repeats(p: Column) -> Column:
    """Drops points equal to the one before, and a last point equal to the first."""
    return opened(changes(p))


def as_points(raw: Column) -> Column:
    return F.transform(raw, lambda q: F.struct(F.get(q, F.lit(0)).alias("x"), F.get(q, F.lit(1)).alias("y")))


def clean_lenient(raw: Column) -> Column:
    """Struct of points and dropped: malformed and non-finite points are left out and counted."""
    good = F.filter(raw, well_formed)
    return F.struct(without_repeats(as_points(good)).alias("points"), (F.size(raw) - F.size(good)).alias("dropped"))


def clean_strict(raw: Column) -> Column:
    """Points without repeats; empty if any point is malformed or non-finite."""
    return F.when(F.exists(raw, lambda q: ~well_formed(q)), F.array().cast(POINTS)).otherwise(without_repeats(as_points(raw)))


def self_intersects(p: Column, tolerance: float = 1e-9) -> Column:
    """Whether two edges that are not neighbours touch or cross; false under four points."""
    n = F.size(p)
    edge = lambda a, i: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), next_point(p, i)["x"].alias("bx"), next_point(p, i)["y"].alias("by"), i.alias("i"))
    edges = F.transform(p, edge)

    def turn(e: Column, x: Column, y: Column) -> Column:
        v = (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
        return F.when(v > tolerance, 1).when(v < -tolerance, -1).otherwise(0)

    def on(e: Column, x: Column, y: Column) -> Column:
        return x.between(F.least(e["ax"], e["bx"]) - tolerance, F.greatest(e["ax"], e["bx"]) + tolerance) & y.between(F.least(e["ay"], e["by"]) - tolerance, F.greatest(e["ay"], e["by"]) + tolerance)

    def sides(e: Column, f: Column) -> Column:
        return F.struct(turn(e, f["ax"], f["ay"]).alias("a"), turn(e, f["bx"], f["by"]).alias("b"), turn(f, e["ax"], e["ay"]).alias("c"), turn(f, e["bx"], e["by"]).alias("d"), e.alias("e"), f.alias("f"))

    def meet(s: Column) -> Column:
        e, f = s["e"], s["f"]
        touch = ((s["a"] == 0) & on(e, f["ax"], f["ay"])) | ((s["b"] == 0) & on(e, f["bx"], f["by"])) | ((s["c"] == 0) & on(f, e["ax"], e["ay"])) | ((s["d"] == 0) & on(f, e["bx"], e["by"]))
        return ((s["a"] != s["b"]) & (s["c"] != s["d"])) | touch

    apart = lambda e: F.filter(edges, lambda f: (f["i"] > e["i"] + 1) & ~((e["i"] == 0) & (f["i"] == n - 1)))
    return F.when(n < 4, F.lit(False)).otherwise(F.exists(edges, lambda e: F.exists(F.transform(apart(e), lambda f: sides(e, f)), meet)))


def canonical(label: Column, p: Column, digits: int = 6) -> Column:
    """One key for all rotations and both directions of a polygon, prefixed by the label. Coordinates are rounded half to even."""
    q = F.transform(p, lambda a: F.struct(F.bround(a["x"], digits).alias("x"), F.bround(a["y"], digits).alias("y")))
    n = F.size(p)
    turned = lambda r: F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.slice(r, i, F.greatest(n - i + 1, F.lit(0))), F.slice(r, F.lit(1), i - 1)))
    least = F.array_min(F.concat(turned(q), turned(F.reverse(q))))
    return F.concat_ws("|", label, F.array_join(F.transform(least, lambda a: F.concat_ws(",", a["x"].cast("string"), a["y"].cast("string"))), ";"))


def repeated(rows: DataFrame, document: str, key: str, order: str) -> DataFrame:
    """Rows whose key occurred earlier in their document; the first occurrence is not flagged."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(document, key).orderBy(order))).where(F.col("occurrence") > 1)


def with_issues(rows: DataFrame, raw: str, label: str, shape_type: str, width: str, height: str, document: str, order: str) -> DataFrame:
    """Adds ``issues``, the array of a shape's issues in the order of the checks (names are fixed values). What several issues use is computed once, in projections of its own.

    Malformed and non-finite points are left out before the other checks. Fewer than three distinct points and no area are raised apart. Without a known
    width and height nothing is out of bounds. A polygon equal to an earlier one of its document (by label, any rotation and direction) is a duplicate.
    """
    pair = F.filter(F.coalesce(F.col(raw), F.array().cast("array<array<double>>")), structured)
    d = rows.withColumn("__pairs", pair).withColumn("__good", F.filter("__pairs", lambda q: F.forall(F.slice(q, 1, 2), finite)))
    d = d.withColumns({"__pts": as_points(F.col("__good")), "__invalid": F.when(F.col(raw).isNull(), 1).otherwise(F.size(raw) - F.size("__pairs")), "__infinite": F.size("__good") < F.size("__pairs")})
    d = d.withColumn("__new", changes(F.col("__pts"))).withColumn("__p", opened(F.col("__new")))
    d = d.withColumns({"__area": area(F.col("__p")), "__box": bounds(F.col("__p")), "__key": canonical(F.coalesce(F.col(label), F.lit("")), F.col("__p"))})
    d = d.withColumn("__occurrence", F.row_number().over(Window.partitionBy(document, "__key").orderBy(order)))
    outside = (F.col("__box.x1") < 0) | (F.col("__box.y1") < 0) | (F.col("__box.x2") > F.col(width)) | (F.col("__box.y2") > F.col(height))
    checks = {
        "non_polygon_shape": F.col(shape_type).isNull() | (F.col(shape_type) != "polygon"),
        "empty_label": F.coalesce(F.col(label), F.lit("")) == "",
        "nan_or_inf_coordinate": F.col("__infinite"),
        "invalid_point_structure": F.col("__invalid") > 0,
        "fewer_than_3_unique_points": F.size(F.array_distinct("__p")) < 3,
        "zero_area_polygon": F.col("__area") <= 0,
        "self_intersection": self_intersects(F.col("__p")),
        "polygon_out_of_bounds": outside,
        "duplicate_polygon": F.col("__occurrence") > 1,
    }
    found = F.array(*[F.when(fits, name) for name, fits in checks.items()])
    return d.withColumn("issues", F.filter(found, lambda x: x.isNotNull())).select(*rows.columns, "issues")


def rejects(rows: DataFrame, raw: str, shape_type: str, width: str, height: str, name: str = "reason") -> DataFrame:
    """Adds why a shape cannot be converted, the first reason (fixed values), null if it can. Points, area and bounds are computed once each, in projections of their own."""
    good = F.filter(F.coalesce(F.col(raw), F.array().cast("array<array<double>>")), well_formed)
    d = rows.withColumn("__good", good)
    d = d.withColumn("__pts", F.when(F.size("__good") == F.size(raw), as_points(F.col("__good"))).otherwise(F.array().cast(POINTS)))
    d = d.withColumn("__new", changes(F.col("__pts"))).withColumn("__p", opened(F.col("__new")))
    d = d.withColumns({"__area": area(F.col("__p")), "__box": bounds(F.col("__p"))})
    box = F.col("__box")
    outside = lambda x1, y1, x2, y2, w, h: (x1 < 0) | (y1 < 0) | (x2 > w) | (y2 > h)
    w, h = F.col(width), F.col(height)
    reason = (
        F.when(F.col(shape_type).isNull() | (F.col(shape_type) != "polygon"), "non_polygon")
        .when(F.size("__p") < 3, "fewer_than_3_valid_points")
        .when(F.col("__area") <= 0, "degenerate_polygon")
        .when(outside(box["x1"], box["y1"], box["x2"], box["y2"], w, h), "coordinate_out_of_bounds")
        .when(outside(box["x1"] / w, box["y1"] / h, box["x2"] / w, box["y2"] / h, 1, 1), "normalized_out_of_range")
    )
    return d.withColumn(name, reason).select(*rows.columns, name)


def normalised(p: Column, width: Column, height: Column) -> Column:
    return F.transform(p, lambda a: F.struct((a["x"] / width).alias("x"), (a["y"] / height).alias("y")))


def denormalised(p: Column, width: Column, height: Column) -> Column:
    return F.transform(p, lambda a: F.struct((a["x"] * width).alias("x"), (a["y"] * height).alias("y")))


def centroid_spread(rows: DataFrame, group: str, image: str, x: str, y: str, close: float = 0.12) -> DataFrame:
    """Greatest distance between two images' mean points in a group, and whether it is small. Images of a group meet pairwise in arrays."""
    means = rows.groupBy(group, image).agg(F.avg(x).alias("x"), F.avg(y).alias("y"))
    arrays = means.groupBy(group).agg(F.collect_list(F.struct("x", "y")).alias("p"))
    spread = F.array_max(F.transform("p", lambda a: F.array_max(F.transform("p", lambda b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])))))
    return arrays.select(group, spread.alias("spread"), F.when(spread <= close, "LIKELY").otherwise("UNCERTAIN").alias("hint"))


def rasterise(points: list[tuple[float, float]], width: int, height: int) -> np.ndarray:
    """Mask of a polygon in unit coordinates: vertices at rint(xy * (w - 1, h - 1)), pixels on edges included, rows filled by even-odd scan."""
    mask = np.zeros((height, width), bool)
    if not len(points):
        return mask
    xs = np.rint(np.array([p[0] for p in points]) * (width - 1)).astype(int)
    ys = np.rint(np.array([p[1] for p in points]) * (height - 1)).astype(int)
    n = len(xs)
    for row in range(max(0, ys.min()), min(height - 1, ys.max()) + 1):
        cuts = []
        for i in range(n):
            x1, y1, x2, y2 = xs[i], ys[i], xs[(i + 1) % n], ys[(i + 1) % n]
            if (y1 <= row) != (y2 <= row):
                cuts.append(x1 + (row - y1) * (x2 - x1) / (y2 - y1))
            if min(y1, y2) <= row <= max(y1, y2):  # the edge's own pixels
                if y1 == y2:
                    lo, hi = sorted((x1, x2))
                else:
                    lo = hi = round(x1 + (row - y1) * (x2 - x1) / (y2 - y1))
                mask[row, max(0, lo) : max(0, hi + 1)] = True
        for lo, hi in zip(sorted(cuts)[::2], sorted(cuts)[1::2], strict=False):
            mask[row, max(0, math.ceil(lo)) : max(0, math.floor(hi) + 1)] = True
    return mask


def encode_runs(mask: np.ndarray) -> list[int]:
    """Row-major run lengths as start, length, start, length, ..."""
    flat = np.concatenate([[0], mask.ravel().astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(flat))
    return np.stack([edges[::2], edges[1::2] - edges[::2]], 1).ravel().tolist()


def runs_iou(a: list[int], b: list[int]) -> float:
    """IoU of two run-length masks; 0 for an empty union."""
    one, two = np.array(a, np.int64).reshape(-1, 2), np.array(b, np.int64).reshape(-1, 2)
    total = int(one[:, 1].sum() + two[:, 1].sum())
    common = i = j = 0
    while i < len(one) and j < len(two):
        lo, hi = max(one[i, 0], two[j, 0]), min(one[i].sum(), two[j].sum())
        common += max(0, int(hi - lo))
        if one[i].sum() < two[j].sum():
            i += 1
        else:
            j += 1
    return common / (total - common) if total > common else 0.0


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def polygon_mask(x: pd.Series, y: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """Run-length mask of polygons given as arrays of unit coordinates."""
    return pd.Series([encode_runs(rasterise(list(zip(a, b, strict=True)), int(w), int(h))) for a, b, w, h in zip(x, y, width, height, strict=True)])


@F.pandas_udf(T.DoubleType())
def mask_iou(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([runs_iou(list(x), list(y)) for x, y in zip(a, b, strict=True)])
