"""Joins of the audit: pairing with unmatched sides, ambiguous candidates, integrity, configurations and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_audit(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every key with its status: paired, left_only or right_only. Keys compare in small letters; nulls pair with nothing."""
    a = left.select(F.lower(F.col(key).cast("string")).alias("key"), F.lit(1).alias("l")).distinct()
    b = right.select(F.lower(F.col(key).cast("string")).alias("key"), F.lit(1).alias("r")).distinct()
    status = F.when(F.col("l").isNull(), "right_only").when(F.col("r").isNull(), "left_only").otherwise("paired")
    return a.join(b, "key", "full_outer").select("key", status.alias("status"))


def unique_pairs(left: DataFrame, right: DataFrame, stem: str, parent: str, path: str) -> DataFrame:
    """(left path, right path): stems with one row on each side; else rows alone in (stem, parent) on both sides. Anything else stays unmatched."""
    alone = lambda d, by, out: d.groupBy(*[F.lower(c).alias(c) for c in by]).agg(F.count("*").alias("n"), F.first(path).alias(out)).where(F.col("n") == 1).drop("n")
    plain = alone(left, [stem], "left_path").join(alone(right, [stem], "right_path"), stem).select("left_path", "right_path")
    near = alone(left, [stem, parent], "left_path").join(alone(right, [stem, parent], "right_path"), [stem, parent]).select("left_path", "right_path")
    rest = near.join(plain.select("left_path"), "left_path", "left_anti").join(plain.select("right_path"), "right_path", "left_anti")
    return plain.unionByName(rest.select("left_path", "right_path"))


def integrity(manifest: DataFrame, now: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows of the manifest whose digest is gone or another now. Empty means intact."""
    d = manifest.select(key, F.col(digest).alias("expected")).join(now.select(key, F.col(digest).alias("found")), key, "left")
    return d.where(F.col("found").isNull() | (F.col("found") != F.col("expected")))


def config_diff(a: DataFrame, b: DataFrame, allowed: list[str]) -> DataFrame:
    """Fields (name, value) of two configurations that differ, with status missing, unexpected, expected or different."""
    d = a.select("name", F.col("value").alias("a"), F.lit(True).alias("in_a")).join(b.select("name", F.col("value").alias("b"), F.lit(True).alias("in_b")), "name", "full_outer")
    status = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "unexpected").when(F.col("a").eqNullSafe(F.col("b")), "equal").when(F.col("name").isin(*allowed), "expected").otherwise("different")
    return d.select("name", "a", "b", status.alias("status")).where(F.col("status") != "equal")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows without those that new rows replace, and the new rows, in the old columns."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True).select(*old.columns)


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of both sides; a leak if the sides must be apart."""
    return a.select(key).intersect(b.select(key))


def latest_line(lines: DataFrame, marker: str, schema: str, text: str = "value", number: str = "line", last: bool = True) -> DataFrame:
    """The JSON after ``marker=`` in the first or last line that has it."""
    found = lines.where(F.col(text).contains(marker + "="))
    pick = F.max_by if last else F.min_by
    return found.agg(pick(text, number).alias("line")).select(F.from_json(F.substring_index("line", marker + "=", -1), schema).alias("record")).select("record.*")


def ordered_labels(rows: DataFrame, key: str, class_id: str, name: str) -> DataFrame:
    """The names of a key's classes in order of class id, joined by |."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_set(F.struct(class_id, name))).alias("s")).select(key, F.array_join(F.transform("s", lambda x: x[name]), "|").alias("labels"))


def split_order(splits: list[str], split: str, stem: str) -> list:
    """Sort keys: the split's place in ``splits``, then the stem as a number."""
    return [F.array_position(F.array(*map(F.lit, splits)), F.col(split)), F.col(stem).cast("long")]


def first_per(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the order."""
    return rows.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__i") == 1).drop("__i")


def zipped(a: DataFrame, b: DataFrame, ordinal: str) -> DataFrame:
    """Rows of two sides by their ordinal, strictly: one that only one side has, or that a side has twice, stops the query. No count of either side is needed beforehand."""
    once = lambda d: d.select(F.col(ordinal), F.struct(*[c for c in d.columns if c != ordinal]).alias("__v")).groupBy(ordinal).agg(F.count("*").alias("__n"), F.first("__v").alias("__v"))
    d = once(a).select(ordinal, F.col("__n").alias("__na"), F.col("__v").alias("__a")).join(once(b).select(ordinal, F.col("__n").alias("__nb"), F.col("__v").alias("__b")), ordinal, "full_outer")
    ok = F.coalesce((F.col("__na") == 1) & (F.col("__nb") == 1), F.lit(False))
    return d.where(F.when(~ok, F.raise_error(F.concat(F.lit("no one partner at ordinal "), F.coalesce(F.col(ordinal).cast("string"), F.lit("null")))).cast("boolean")).otherwise(F.lit(True))).select(ordinal, "__a.*", "__b.*")


def subset_groups(members: DataFrame, group: str, labels: str) -> DataFrame:
    """Per group whether one member's label set is a proper subset of another's; empty sets count for nothing. Members meet by their distinct sets only, of which a group has few."""
    sets = members.select(group, F.array_sort(F.array_distinct(F.filter(labels, lambda x: x.isNotNull()))).alias("s")).where(F.size("s") > 0)
    per = sets.groupBy(group).agg(F.collect_set("s").alias("sets"))
    proper = lambda a, b: (F.size(F.array_except(a, b)) == 0) & (F.size(b) > F.size(a))
    found = per.select(group, F.exists("sets", lambda a: F.exists("sets", lambda b: proper(a, b))).alias("subset_relation"))
    return members.select(group).distinct().join(found, group, "left").na.fill(False, ["subset_relation"])
