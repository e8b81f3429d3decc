"""Scalar expressions shared by the operators; all stay inside whole-stage code generation or built-in higher-order functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(tp: Column, predicted: Column, actual: Column) -> Column:
    return ratio(2 * tp, predicted + actual)


def percentiles(column: str, at: Sequence[float], where: Column | None = None) -> Column:
    """Exact percentiles with linear interpolation; null without values."""
    c = F.col(column) if where is None else F.when(where, F.col(column))
    return F.percentile(c, F.array(*map(F.lit, at)))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def bits_to_long(bits: Column) -> Column:
    """An array of at most 64 booleans as a 64-bit number, the first one highest."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b.cast("long")))


def hex64(hash_: Column) -> Column:
    return F.lower(F.lpad(F.hex(hash_), 16, "0"))


def box_iou(a: str, b: str, joint: str = "_") -> Column:
    """IoU of boxes a_x1.. and b_x1.. (exclusive upper ends); negative extents count as 0, an empty union gives 0."""
    c = lambda p, k: F.col(f"{p}{joint}{k}").cast("double")
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1")))
    h = F.greatest(zero, F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1")))
    area = lambda p: F.greatest(zero, c(p, "x2") - c(p, "x1")) * F.greatest(zero, c(p, "y2") - c(p, "y1"))
    return ratio(w * h, area(a) + area(b) - w * h)


def box_area(p: str) -> Column:
    c = lambda k: F.col(f"{p}_{k}").cast("double")
    return F.greatest(F.lit(0.0), c("x2") - c("x1")) * F.greatest(F.lit(0.0), c("y2") - c("y1"))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def size_bin(area: Column, q25: Column, q50: Column, q75: Column) -> Column:
    """Right-closed quartile bins."""
    return F.when(area <= q25, "tiny").when(area <= q50, "small").when(area <= q75, "medium").otherwise("large")


def padded_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, scale: float = 1.2, least: float = 2.0) -> Column:
    """Box scaled about its centre, of at least ``least`` a side, rounded half to even and clipped to the image."""
    side = lambda lo, hi: F.greatest((hi - lo) * scale, F.lit(least))
    mid = lambda lo, hi: (lo + hi) / 2
    low = lambda lo, hi: F.greatest(F.lit(0.0), F.bround(mid(lo, hi) - side(lo, hi) / 2, 0)).cast("int")
    high = lambda lo, hi, end: F.least(end.cast("double"), F.bround(mid(lo, hi) + side(lo, hi) / 2, 0)).cast("int")
    return F.struct(low(x1, x2).alias("x1"), low(y1, y2).alias("y1"), high(x1, x2, width).alias("x2"), high(y1, y2, height).alias("y2"))


def similarity_hint(p: Column, d: Column, corr: Column) -> Column:
    """What an unlabelled image may be, in three tiers of likeness to a labelled one (fixed values)."""
    return F.when((p <= 6) & (d <= 8) & (corr >= 0.98), "possible_missing_json").when((p <= 12) & (d <= 14) & (corr >= 0.95), "possible_missing_annotation").otherwise("unknown")


def tensor_category(name: Column) -> Column:
    """What a named tensor is, by its suffix; the first rule that fits counts (fixed values)."""
    return (
        F.when(name.endswith("running_mean"), "bn_running_mean")
        .when(name.endswith("running_var"), "bn_running_var")
        .when(name.endswith("num_batches_tracked"), "bn_num_batches_tracked")
        .when(name.endswith(".conv.weight") | (name.endswith(".weight") & ~name.contains(".bn.")), "conv_weight")
        .when(name.endswith(".bn.weight"), "bn_weight")
        .when(name.endswith(".bn.bias"), "bn_bias")
        .otherwise("other")
    )


def draw_probability(hard: Column, weight: Column, normal: Column) -> Column:
    """Chance that a weighted draw takes a hard row."""
    return ratio(hard * weight, hard * weight + normal)
