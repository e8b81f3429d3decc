"""Profiling: class statistics, co-occurrence, distributions, runs, samples and semi-structured fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.exprs import percentiles, ratio
from gaugeflow.operators.ranking import global_place

DESCRIBE = (0.25, 0.5, 0.75, 0.9, 0.95)


def class_statistics(instances: DataFrame, image: str, label: str, area: str, tiny: float, medians: tuple[str, ...] = ()) -> DataFrame:
    """Per class: images, instances, their shares, tiny instances, the median area and the medians of further columns (vertices, relative area, aspect). The totals are one row."""
    per = instances.groupBy(F.col(label).alias("class")).agg(
        F.countDistinct(image).alias("images"), F.count("*").alias("instances"),
        F.count_if(F.col(area) < tiny).alias("tiny"), F.median(area).alias("median_area"), *[F.median(c).alias(f"median_{c}") for c in medians],
    )
    totals = instances.agg(F.countDistinct(image).alias("all_images"), F.count("*").alias("all_instances"))
    return per.crossJoin(F.broadcast(totals)).select(
        "class", "images", "instances", ratio(F.col("images"), F.col("all_images")).alias("image_share"),
        ratio(F.col("instances"), F.col("all_instances")).alias("instance_share"), "tiny", ratio(F.col("tiny"), F.col("instances")).alias("tiny_share"), "median_area", *[f"median_{c}" for c in medians],
    )


def cooccurrence(instances: DataFrame, image: str, label: str) -> DataFrame:
    """(class_a, class_b, images) over the full grid of classes; the diagonal counts a class's own images."""
    held = instances.select(F.col(image).alias("image"), F.col(label).alias("class")).distinct()
    # a row an image keeps the join on classes small: an image has few distinct ones
    sets = held.groupBy("image").agg(F.collect_set("class").alias("classes"))
    pairs = sets.select(F.explode("classes").alias("class_a"), "classes").select("class_a", F.explode("classes").alias("class_b")).groupBy("class_a", "class_b").agg(F.count("*").alias("images"))
    names = held.select("class").distinct()
    grid = names.select(F.col("class").alias("class_a")).crossJoin(names.select(F.col("class").alias("class_b")))  # classes are few
    return grid.join(pairs, ["class_a", "class_b"], "left").select("class_a", "class_b", F.coalesce("images", F.lit(0)).cast("long").alias("images"))


def describe(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """count, min, exact percentiles, max and mean of each group; nulls without values."""
    d = rows.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("lowest"), percentiles(value, DESCRIBE).alias("p"), F.max(value).alias("highest"), F.round(F.avg(value), 4).alias("mean"))
    return d.select(*by, "n", "lowest", *[F.col("p")[i].alias(f"p{round(100 * q)}") for i, q in enumerate(DESCRIBE)], "highest", "mean")


def children_histogram(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    """How many parents have how many children, those without included."""
    counts = children.groupBy(F.col(child_key).alias("__k")).agg(F.count("*").alias("children"))
    return parents.join(counts, F.col(key) == F.col("__k"), "left").groupBy(F.coalesce("children", F.lit(0)).cast("long").alias("children")).agg(F.count("*").alias("parents"))


def top_values(rows: DataFrame, value: str, position: str, k: int) -> DataFrame:
    """The k most frequent values, ties by first position."""
    d = rows.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    return d.orderBy(F.col("n").desc(), "first").limit(k)


def runs(values: DataFrame, value: str, least: int = 3) -> DataFrame:
    """Runs of consecutive whole numbers (repeated ones count once), of at least ``least``: first, last and length.

    Islands share value - row number. The number is counted within ranges of values and offset by the ranges' counts, so no task sorts everything.
    """
    d = values.select(F.col(value).cast("long").alias("v")).where(F.col("v").isNotNull()).distinct()
    d = d.withColumn("range", F.shiftright("v", 16))
    own = d.withColumn("i", F.row_number().over(Window.partitionBy("range").orderBy("v")))
    # only islands that touch a range's end may go on in the next: two a range at most are put in order
    parts = own.groupBy("range", (F.col("v") - F.col("i")).alias("island")).agg(F.min("v").alias("first"), F.max("v").alias("last"))
    touches = (F.col("first") == F.shiftleft("range", 16)) | (F.col("last") == F.shiftleft(F.col("range") + 1, 16) - 1)
    edge = Window.orderBy("first")
    joined = parts.where(touches).withColumn("new", (F.coalesce(F.lag("last").over(edge) + 1 != F.col("first"), F.lit(True))).cast("int"))
    joined = joined.withColumn("group", F.sum("new").over(edge.rowsBetween(Window.unboundedPreceding, 0)))
    merged = joined.groupBy("group").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("group")
    return parts.where(~touches).select("first", "last").unionByName(merged).select("first", "last", (F.col("last") - F.col("first") + 1).alias("length")).where(F.col("length") >= least)


def even_sample(rows: DataFrame, order: str, k: int) -> DataFrame:
    """At most k rows, evenly spaced in the order: places floor(i (n - 1) / (k - 1)). ``order`` must be unique.

    Only the order travels to find the places; the chosen keys then pick their rows.
    """
    placed = global_place(rows.select(order), [F.col(order)])
    size = placed.agg(F.count("*").alias("all")).select("all", F.least(F.lit(k), F.col("all")).alias("size"))
    chosen = size.where("size > 0").select(F.explode(F.expr("transform(sequence(0, cast(size AS int) - 1), i -> if(size > 1, floor(i * (all - 1) / (size - 1)), 0))")).alias("place"))
    keys = placed.join(F.broadcast(chosen), "place").select(order, "place")  # k places
    return rows.join(F.broadcast(keys), order).select(*rows.columns, "place")


def field_profile(rows: DataFrame, json: str) -> DataFrame:
    """Of a JSON object column: each key's rows, nulls, distinct values, and type seen (number, string, boolean, other)."""
    d = rows.select(F.from_json(json, "map<string,string>").alias("m")).select(F.explode("m").alias("key", "value"))
    kind = F.when(F.col("value").isNull(), "null").when(F.col("value").rlike(r"^-?[0-9]+(\.[0-9]+)?$"), "number").when(F.col("value").isin("true", "false"), "boolean").when(F.col("value").rlike(r"^[\[{]"), "other").otherwise("string")
    return d.withColumn("kind", kind).groupBy("key", "kind").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"), F.min(F.length("value")).alias("shortest"), F.max(F.length("value")).alias("longest"))


#: Kinds of documents by their path, in small letters (fixed values).
AUTHORITATIVE = r"docs/(exp\d|handoffs/|project_state|decision_log|historical_methods)|changelog"
SUMMARY = r"review|timeline|takeaways|index|final_|paper|readme|roadmap|project_scope"


def language_audit(docs: DataFrame, text: str, path: str, rewritten: list[str] | None = None) -> DataFrame:
    """Language of each document by its CJK characters (U+3400 to U+9FFF) against its Latin tokens, its kind by its path, and what to do with it (names and limits are fixed values).

    A text without either is mixed. ``rewritten`` names summaries that are rewritten whatever their language. Adds n_zh, n_en, language, document_type, needs_translation, needs_rewrite, action.
    """
    d = docs.withColumns({"n_zh": F.regexp_count(F.col(text), F.lit("[\u3400-\u9fff]")).cast("long"), "n_en": F.regexp_count(F.col(text), F.lit("[A-Za-z][A-Za-z0-9_.+-]*")).cast("long")})
    total = F.greatest(F.lit(1), F.col("n_zh") + F.col("n_en"))
    zh, en, lower = F.col("n_zh") / total, F.col("n_en") / total, F.lower(path)
    d = d.withColumn("language", F.when(zh >= 0.70, "zh-dominant").when(en >= 0.70, "en-dominant").otherwise("mixed"))
    authoritative, summary = F.regexp_like(lower, F.lit(AUTHORITATIVE)), F.regexp_like(lower, F.lit(SUMMARY))
    d = d.withColumn("document_type", F.when(authoritative, "authoritative_experiment_or_gate").when(summary, "project_summary").otherwise("supporting_document"))
    d = d.withColumns({"needs_translation": (authoritative | summary) & (en > 0.45), "needs_rewrite": summary & ((en > 0.30) | F.col(path).isin(*(rewritten or [])))})
    action = (
        F.when(F.col("needs_translation") & authoritative, "keep_original_create_zh_companion")
        .when(F.col("needs_rewrite"), "keep_original_create_full_zh_reorganization")
        .when(authoritative | summary, "keep_original_reference_from_zh_hub")
        .otherwise("keep_original_and_index")
    )
    return d.withColumn("action", action)


def name_counts(rows: DataFrame, stem: str) -> DataFrame:
    """(kind, name, n): names that are all digits (kind numeric, null name), and prefixes of names that end in a number, with a _ or - before it left out (kind prefix). Digits are ASCII."""
    prefix = F.regexp_extract(F.col(stem), r"^(.*?)(?:[_-]?[0-9]+)$", 1)
    kinds = F.array(F.struct(F.lit("numeric").alias("kind"), F.lit(None).cast("string").alias("name"), F.col(stem).rlike(r"^[0-9]+$").alias("ok")), F.struct(F.lit("prefix").alias("kind"), prefix.alias("name"), (prefix != "").alias("ok")))
    return rows.select(F.explode(kinds).alias("x")).select("x.*").where("ok").groupBy("kind", "name").agg(F.count("*").alias("n"))


def of_split(rows: DataFrame, split: str, wanted: str, known: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """The rows of one split. A row of an unknown split stops the query as it is read, whatever is wanted."""
    if wanted not in known:
        raise ValueError(f"unknown split {wanted!r}")
    ok = F.coalesce(F.col(split).isin(*known), F.lit(False))
    kept = F.when(~ok, F.raise_error(F.concat(F.lit("unknown split "), F.coalesce(F.col(split).cast("string"), F.lit("null")))).cast("boolean")).otherwise(F.col(split) == wanted)
    return rows.where(kept)


def value_profile(rows: DataFrame, json: str, field: str, k: int = 50) -> DataFrame:
    """Of one field of JSON documents: (part, value, n) with part type (missing without the field), length of strings, arrays and objects, and the ``k`` most frequent values (items of arrays), ties to the smaller value."""
    v = F.try_variant_get(F.try_parse_json(json), f"$.{field}", "variant")
    kind = F.when(v.isNull(), "missing").otherwise(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0))
    d = rows.select(v.alias("v"), kind.alias("type")).withColumn("type", F.when(F.col("type") == "VOID", "null").otherwise(F.lower("type")))
    text = F.col("v").cast("string")
    items = F.when(F.col("type") == "array", F.col("v").cast("array<string>"))
    d = d.withColumns({"items": items, "text": text})
    size = F.when(F.col("type") == "array", F.size("items")).when(F.col("type") == "string", F.length("text")).when(F.col("type") == "object", F.size(F.json_object_keys("text")))
    part = lambda d, name, value: d.groupBy(value.cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "value", "n")
    values = d.where(F.col("type") != "missing").select(F.explode(F.coalesce("items", F.array("text"))).alias("value"))
    top = part(values, "value", F.col("value")).orderBy(F.col("n").desc(), F.col("value").asc_nulls_last()).limit(k)
    return part(d, "type", F.col("type")).unionByName(part(d.where(size.isNotNull()), "length", size)).unionByName(top)


def version_profile(documents: DataFrame, version: str, labels: str, path: str, stem: str) -> DataFrame:
    """(version, part, value, n, lowest, highest): per version its documents, instances of each label, documents of each file suffix, and count, least and greatest of all-digit stems. A null version is <missing>."""
    d = documents.withColumn("__v", F.coalesce(F.col(version).cast("string"), F.lit("<missing>")))
    null = F.lit(None).cast("long")
    count = lambda d, part, value: d.groupBy(F.col("__v").alias("version"), value.alias("value")).agg(F.count("*").alias("n")).select("version", F.lit(part).alias("part"), "value", "n", null.alias("lowest"), null.alias("highest"))
    none = F.lit(None).cast("string")
    numbers = d.where(F.col(stem).rlike("^[0-9]+$")).groupBy(F.col("__v").alias("version")).agg(F.count("*").alias("n"), F.min(F.col(stem).cast("long")).alias("lowest"), F.max(F.col(stem).cast("long")).alias("highest"))
    numbers = numbers.select("version", F.lit("stem").alias("part"), none.alias("value"), "n", "lowest", "highest")
    suffix = F.lower(F.regexp_extract(F.col(path), r"(\.[^./\\]+)$", 1))
    return count(d, "documents", none).unionByName(count(d.select("__v", F.explode(labels).alias("l")), "label", F.coalesce(F.col("l"), F.lit("")))).unionByName(count(d, "suffix", suffix)).unionByName(numbers)


def presence(c: Column) -> Column:
    return F.when(c.isNotNull(), "present_non_null").otherwise("missing_or_null")
