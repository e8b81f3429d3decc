"""Report frames: flattened metrics, latencies, integrity of training rows, class remaps, page packing, document kinds and safe export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.exprs import finite, ratio


def long_metrics(wide: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, value): every other column as a row."""
    return wide.unpivot(keys, [c for c in wide.columns if c not in keys], "metric", "value")


def flat_metrics(records: DataFrame, keys: list[str], families: list[str], names: list[str]) -> DataFrame:
    """Nested records family.name as columns family_name."""
    return records.select(*keys, *[F.col(f"{a}.{b}").alias(f"{a}_{b}") for a in families for b in names])


def latency(images: DataFrame, candidates: DataFrame, key: str, ms: str) -> DataFrame:
    """Mean and median of the first stage, of the second a candidate, and of both an image. Images join by id; one without candidates costs its first stage."""
    per = candidates.groupBy(key).agg(F.sum(ms).alias("__second"))
    d = images.join(per, key, "left").withColumn("__all", F.col(ms) + F.coalesce("__second", F.lit(0.0)))
    two = candidates.agg(F.avg(ms).alias("second_mean"), F.median(ms).alias("second_median"))
    return d.agg(F.avg(ms).alias("first_mean"), F.median(ms).alias("first_median"), F.avg("__all").alias("all_mean"), F.median("__all").alias("all_median")).crossJoin(two)


def training_rows(images: DataFrame, lines: DataFrame, stem: str, classes: int) -> DataFrame:
    """Integrity of training images, a row each with the reference columns (fixed names).

    ``images`` has dataset_index, the stem as ``stem``, is_hard, image_path, label_path, image_decode_ok and image_finite; ``lines`` the stem, ``number`` (from 0) and ``line``, the text of one label line. One line that does
    not parse (under three points, an odd number of coordinates, no number) makes the whole file unparsed, with all its flags false; counts and areas are then those of the lines before it.
    """
    from gaugeflow.operators.geometry import area, bounds

    numbers = F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.try_cast("double"))
    d = lines.where(F.trim("line") != "").select(stem, "number", numbers.alias("v"))
    d = d.withColumn("sound", (F.size("v") >= 7) & (F.size("v") % 2 == 1) & ~F.exists("v", lambda x: x.isNull()))
    first = d.where(~F.col("sound")).groupBy(stem).agg(F.min("number").alias("broken"))
    d = d.join(first, stem, "left").withColumn("ok", F.col("broken").isNull() | (F.col("number") < F.col("broken")))
    points = F.transform(F.sequence(F.lit(1), F.floor((F.size("v") - 1) / 2).cast("int")), lambda i: F.struct(F.get("v", 2 * i - 1).alias("x"), F.get("v", 2 * i).alias("y")))
    d = d.withColumn("p", F.when(F.col("ok"), points)).withColumns({"a": area(F.col("p")), "b": bounds(F.col("p")), "c": F.get("v", F.lit(0))})
    every = lambda c: F.every(F.when(F.col("ok"), c).otherwise(F.lit(True)))
    per = d.groupBy(stem).agg(
        F.every("sound").alias("label_parse_ok"), every(F.forall("p", lambda q: finite(q["x"]) & finite(q["y"]))).alias("polygon_finite"),
        every(F.forall("p", lambda q: q["x"].between(0, 1) & q["y"].between(0, 1))).alias("coordinate_range_ok"), every((F.col("c") == F.floor("c")) & (F.col("c") >= 0) & (F.col("c") < classes)).alias("class_id_ok"),
        F.count_if("ok").alias("instance_count"), F.count_if(F.col("ok") & (F.col("a") <= 1e-12)).alias("degenerate_polygon_count"),
        F.count_if(F.col("ok") & ((F.col("b.x2") <= F.col("b.x1")) | (F.col("b.y2") <= F.col("b.y1")))).alias("degenerate_bbox_count"), F.sum(F.when(F.col("ok"), F.col("a")).otherwise(0.0)).alias("relative_polygon_area_sum"),
    )
    flags = ["polygon_finite", "coordinate_range_ok", "class_id_ok"]
    # an image without lines has an empty file: it parses, but has no instance
    out = images.join(per, stem, "left").na.fill(True, ["label_parse_ok", *flags]).na.fill(0, ["instance_count", "degenerate_polygon_count", "degenerate_bbox_count"]).na.fill(0.0, ["relative_polygon_area_sum"])
    out = out.withColumns({c: F.col("label_parse_ok") & F.col(c) for c in flags})
    good = F.col("label_parse_ok") & F.col("polygon_finite") & F.col("coordinate_range_ok") & F.col("class_id_ok") & (F.col("instance_count") > 0) & (F.col("degenerate_polygon_count") == 0) & (F.col("degenerate_bbox_count") == 0)
    out = out.withColumns({"valid_image": F.col("image_decode_ok") & F.col("image_finite"), "valid_target": good})
    return out.select(
        "dataset_index", F.col(stem).alias("image_stem"), "is_hard", "image_path", "label_path", "image_decode_ok", "image_finite", "label_parse_ok", *flags,
        "instance_count", "degenerate_polygon_count", "degenerate_bbox_count", "relative_polygon_area_sum", "valid_image", "valid_target",
    )


def training_summary(rows: DataFrame) -> DataFrame:
    """One row: invalid images and targets, in all and among the hard ones."""
    bad = lambda c: ~F.col(c)
    return rows.agg(F.count_if(bad("valid_image")).alias("invalid_images"), F.count_if(bad("valid_target")).alias("invalid_targets"), F.count_if(F.col("is_hard") & bad("valid_image")).alias("hard_invalid_images"), F.count_if(F.col("is_hard") & bad("valid_target")).alias("hard_invalid_targets"))


def counter_json(rows: DataFrame, key: str, label: str) -> DataFrame:
    """(key, counts): a JSON object of how often each label occurs with the key, names in order. A null label is the name null."""
    per = rows.groupBy(key, F.coalesce(F.col(label).cast("string"), F.lit("null")).alias("l")).agg(F.count("*").alias("n"))
    return per.groupBy(key).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("l", "n"))))).alias("counts"))


def counter_rows(encoded: DataFrame, key: str, counts: str = "counts") -> DataFrame:
    """(key, label, n) of such objects; what does not parse has no rows."""
    return encoded.select(key, F.explode(F.from_json(counts, "map<string,bigint>")).alias("label", "n"))


def array_json(values: Column) -> Column:
    """An array as JSON text; null stays null."""
    return F.to_json(values)


def json_array(text: Column, kind: str = "double") -> Column:
    """The array of a JSON text; null if it is none."""
    return F.from_json(text, f"array<{kind}>")


def conflict_review(members: DataFrame, edges: DataFrame, group: str = "group_id") -> DataFrame:
    """Review table of groups whose members' label sets differ (names and hints are fixed values).

    ``members``: group, member, counts (array of label and n, by label), x and y (mean centroid in unit coordinates, null without shapes); ``edges``: group, phash_distance, dhash_distance, correlation.
    A group is a component of near duplicates; its members meet in arrays, which a hot group makes long: spreads compare the extreme points first, which hold the greatest distance.
    """
    from gaugeflow.operators.joins import subset_groups

    d = members.withColumns({"labels": F.transform("counts", lambda x: x["label"]), "signature": F.array_join(F.transform("counts", lambda x: F.concat(x["label"], F.lit(":"), x["n"].cast("string"))), "|")})
    d = d.withColumn("class_set", F.array_join("labels", "|"))
    per = d.groupBy(group).agg(
        F.count("*").alias("member_count"), F.array_join(F.sort_array(F.collect_list(F.col("member").cast("string"))), "|").alias("members"), F.array_join(F.sort_array(F.collect_set("class_set")), ";").alias("class_sets"),
        F.array_join(F.sort_array(F.collect_set("signature")), ";").alias("annotation_signatures"), F.countDistinct("class_set").alias("__sets"),
    ).where(F.col("__sets") > 1)
    ends = edges.groupBy(group).agg(*[f(c).alias(f"{n}_{c}") for c in ("phash_distance", "dhash_distance", "correlation") for f, n in ((F.min, "min"), (F.max, "max"))])
    spots = d.where(F.col("x").isNotNull()).groupBy(group).agg(F.collect_set(F.struct("x", "y")).alias("p"))
    spread = spots.select(group, F.array_max(F.transform("p", lambda a: F.array_max(F.transform("p", lambda b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]))))).alias("spread"))
    out = per.join(ends, group, "left").join(spread, group, "left").join(subset_groups(d, group, "labels"), group)
    return out.select(
        group, "member_count", "members", "class_sets", "annotation_signatures", *[c for c in ends.columns if c != group],
        F.when(F.col("spread") <= 0.12, "LIKELY").otherwise("UNCERTAIN").alias("same_defect_location_program_hint"), F.coalesce("spread", F.lit(0.0)).alias("normalized_mean_centroid_spread"),
        F.when(F.col("subset_relation"), "POSSIBLE").otherwise("NOT_INFERRED").alias("one_image_seems_incompletely_annotated_program_hint"), F.lit("PENDING_HUMAN_REVIEW").alias("human_group_decision"),
    )


def one_class(images: DataFrame, shapes: DataFrame, key: str, class_id: str, keep: int) -> DataFrame:
    """Images with their shapes of one class, renumbered 0; others stay as background with a count of 0."""
    kept = shapes.where(F.col(class_id) == keep).groupBy(key).agg(F.count("*").alias("instances"))
    return images.join(kept, key, "left").na.fill(0, ["instances"]).withColumn("class_id", F.when(F.col("instances") > 0, F.lit(0)))


def coverage(shapes: DataFrame, key: str, area: str, width: str, height: str) -> DataFrame:
    """Sum of shape areas over the image's; overlaps count twice, by definition."""
    return shapes.groupBy(key).agg((F.sum(area) / F.max(F.col(width) * F.col(height))).alias("coverage"))


def label_counts(shapes: DataFrame, key: str, label: str) -> DataFrame:
    """One row: images of one label and of several, and the ratio of the largest class to the smallest."""
    sets = shapes.groupBy(key).agg(F.countDistinct(label).alias("n"))
    sizes = shapes.groupBy(label).agg(F.count("*").alias("__n")).agg(ratio(F.max("__n"), F.min("__n")).alias("imbalance"))
    return sets.agg(F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") > 1).alias("multiple")).crossJoin(sizes)


def pages(groups: list[tuple[str, int]], most_groups: int = 12, most_rows: int = 10) -> list[list[str]]:
    """Groups (name, rows) packed in order; a page closes when the next would pass either limit. A display of few groups, on the driver."""
    out: list[list[str]] = []
    rows = 0
    for name, n in groups:
        if not out or len(out[-1]) == most_groups or rows + n > most_rows:
            out.append([])
            rows = 0
        out[-1].append(name)
        rows += n
    return out


def document_kind(path: Column, rules: list[tuple[str, str]], other: str = "other") -> Column:
    """The first rule (pattern, kind) that the path meets."""
    kind = F.lit(other)
    for pattern, name in reversed(rules):
        kind = F.when(F.regexp_like(path, F.lit(pattern)), name).otherwise(kind)
    return kind


def safe_json(row: Column, doubles: list[str]) -> Column:
    """JSON of a struct whose named doubles may be NaN or infinite; those become strings."""
    for c in doubles:
        v = row[c]
        row = row.withField(c, F.when(F.isnan(v), "NaN").when(v == float("inf"), "Infinity").when(v == -float("inf"), "-Infinity").otherwise(v.cast("string")))
    return F.to_json(row)


def array_digest(dtype: Column, shape: Column, content: Column) -> Column:
    """SHA-256 of an array's type, shape and bytes."""
    head = F.concat_ws("|", dtype, F.array_join(F.transform(shape, lambda x: x.cast("string")), ","))
    return F.sha2(F.concat(head.cast("binary"), F.lit("|").cast("binary"), content), 256)


def stamped(rows: DataFrame, name: str = "generated_at") -> DataFrame:
    """``rows`` with the time of the query in UTC, ISO 8601, the same in every row. Leave it out of digests."""
    return rows.withColumn(name, F.date_format(F.convert_timezone(None, F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
