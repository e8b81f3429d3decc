"""Files in and out: scans with digests, permissive JSON, tidy CSV, line logs, immutable writes and provenance."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.operators.gates import table_digest

IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp")
SHAPE = T.StructType([
    T.StructField("label", T.StringType()), T.StructField("points", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("group_id", T.StringType()), T.StructField("shape_type", T.StringType()),
])
ANNOTATION = T.StructType([
    T.StructField("version", T.StringType()), T.StructField("flags", T.MapType(T.StringType(), T.StringType())), T.StructField("shapes", T.ArrayType(SHAPE)),
    T.StructField("imagePath", T.StringType()), T.StructField("imageData", T.StringType()), T.StructField("imageHeight", T.IntegerType()), T.StructField("imageWidth", T.IntegerType()),
    T.StructField("_corrupt_record", T.StringType()),
])


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.[^.]+$", "")


def label_path(path: Column) -> Column:
    """The label file beside an image: folder images becomes labels, the suffix .txt."""
    return F.regexp_replace(F.regexp_replace(path, "/images/", "/labels/"), r"\.[^./]+$", ".txt")


def absolute(path: Column) -> Column:
    return path.startswith("/") | path.rlike(r"^[A-Za-z]:[\\/]")


def scan(spark: SparkSession, folder: str, digest: bool = True) -> DataFrame:
    """relative_path, file_type (image, json or other), size_bytes and sha256 of all files below a folder, unordered.

    Without ``digest`` no content is read. The reader leaves empty files out; they come from its list of files, which the driver holds anyway.
    """
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    listed = spark.createDataFrame([(re.sub("^file:/+", "file:/", unquote(p)),) for p in d.inputFiles()], "path string")
    own = F.sha2("content", 256) if digest else F.lit(None).cast("string")
    d = listed.join(d.select("path", "length", own.alias("sha256")), "path", "left")
    name = F.regexp_replace(F.col("path"), "^.*?" + _quoted(folder.rstrip("/").split("://")[-1]) + "/", "")
    kind = F.when(suffix(name).isin(*IMAGE_SUFFIXES), "image").when(suffix(name) == ".json", "json").otherwise("other")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return d.select(name.alias("relative_path"), kind.alias("file_type"), F.coalesce("length", F.lit(0)).alias("size_bytes"), *([F.coalesce("sha256", empty).alias("sha256")] if digest else []))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c == "/" else "\\" + c for c in text)


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    """Path, raw text, parsed annotation and problem of every JSON file: json_error, shapes_missing, shapes_not_list or schema_mismatch (a field of another type), null if none. Such a file is a row, not an error. A byte order mark is dropped."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder)
    raw = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    d = d.select("path", raw.alias("raw")).withColumn("a", F.from_json("raw", ANNOTATION, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    shapes = F.try_variant_get(F.try_parse_json("raw"), "$.shapes", "variant")
    problem = (
        F.when(F.try_parse_json("raw").isNull(), "json_error").when(shapes.isNull(), "shapes_missing").when(~F.schema_of_variant(shapes).startswith("ARRAY"), "shapes_not_list")
        .when(F.col("a").isNull() | F.col("a._corrupt_record").isNotNull(), "schema_mismatch")
    )
    return d.withColumn("problem", problem)


def shapes(parsed: DataFrame) -> DataFrame:
    """A row a shape, with its index; documents without shapes give none."""
    return parsed.where(F.col("problem").isNull()).select("path", F.posexplode("a.shapes").alias("shape_index", "s")).select("path", "shape_index", "s.*")


def document_issues(parsed: DataFrame, images: DataFrame | None = None, path: str = "path", raw: str = "raw") -> DataFrame:
    """(path, shape_index, issue): shapes_not_list of a document whose shapes are something else than a list, shape_not_object of each entry that is no object (by its index), and
    image_dimension_mismatch where ``images`` (path, width, height of the document's image) has another size than the document declares. Names are fixed values; a missing list is an empty one.
    """
    d = parsed.select(F.col(path).alias("path"), F.try_parse_json(raw).alias("v"))
    d = d.withColumn("shapes", F.try_variant_get("v", "$.shapes", "variant"))
    is_list = F.coalesce(F.schema_of_variant("shapes").startswith("ARRAY"), F.lit(False))
    none = F.lit(None).cast("int")
    lists = d.where(F.col("shapes").isNotNull() & ~is_list).select("path", none.alias("shape_index"), F.lit("shapes_not_list").alias("issue"))
    entries = d.where(is_list).select("path", F.posexplode(F.col("shapes").cast("array<variant>")).alias("shape_index", "entry"))
    broken = entries.where(~F.coalesce(F.schema_of_variant("entry").startswith("OBJECT"), F.lit(False))).select("path", "shape_index", F.lit("shape_not_object").alias("issue"))
    out = lists.unionByName(broken)
    if images is None:
        return out
    declared = d.select("path", F.try_variant_get("v", "$.imageWidth", "int").alias("dw"), F.try_variant_get("v", "$.imageHeight", "int").alias("dh"))
    sized = images.select("path", F.col("width").alias("tw"), F.col("height").alias("th")).where(F.col("tw").isNotNull() & F.col("th").isNotNull())
    off = declared.join(sized, "path").where(~F.col("dw").eqNullSafe(F.col("tw")) | ~F.col("dh").eqNullSafe(F.col("th")))
    return out.unionByName(off.select("path", none.alias("shape_index"), F.lit("image_dimension_mismatch").alias("issue")))


def key_counts(parsed: DataFrame) -> DataFrame:
    """How often each key occurs at the top of the documents."""
    return parsed.select(F.explode(F.json_object_keys("raw")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; names and values are trimmed, a byte order mark is dropped, empty cells are null. With a schema, columns are cast by ``try_cast``."""
    d = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    d = d.toDF(*[c.strip().lstrip("﻿") for c in d.columns])
    if schema is None:
        return d
    want = T._parse_datatype_string(schema)
    return d.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in want.fields])


def cast_violations(raw: DataFrame, numeric: list[str]) -> DataFrame:
    """Cells of the named columns that hold something which is no number: row values kept, with the column's name."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in numeric])
    return raw.select("*", F.explode_outer(cells).alias("__c")).where(F.col("__c.value").isNotNull() & F.col("__c.value").try_cast("double").isNull()).select(*raw.columns, "__c.*")


def flag(text: Column) -> Column:
    """True, true and TRUE are true, the same of false; anything else is null."""
    return F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)


def rendered(value: Column, missing: str = "N/A") -> Column:
    """For export: a sentinel for null, names for NaN and the infinities."""
    as_text = value.cast("string")
    return F.coalesce(as_text, F.lit(missing))


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The named columns in their order, others left out; an existing path is never overwritten."""
    df.select(*columns).write.mode("errorifexists").csv(path, header=True)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value and line: a number that grows in the order of the file. One file is one partition, as lines have no number of their own."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value"))


def freeze(df: DataFrame, path: str, by: str, note: dict[str, str]) -> DataFrame:
    """Writes a dataset partitioned by ``by``, once and for all, with a provenance record beside it, and returns that."""
    spark = df.sparkSession
    df.write.mode("errorifexists").partitionBy(by).parquet(f"{path}/data")
    record = table_digest(df.select(*sorted(df.columns))).withColumns({k: F.lit(v) for k, v in note.items()})
    record.coalesce(1).write.mode("errorifexists").json(f"{path}/provenance")
    return spark.read.json(f"{path}/provenance")


def simple_yaml(text: str) -> dict:
    """A configuration of the kind that datasets carry: ``key: value`` lines, and under a key without value either ``- item`` lines or indented ``key: value`` lines. Comments and blank lines are skipped; numbers, booleans and null are typed. Anything deeper raises ValueError."""
    out: dict = {}
    last = None
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip() if not line.lstrip().startswith("#") else ""
        if not bare.strip():
            continue
        body = bare.strip()
        if bare[0] in " -" and last is not None:
            if body.startswith("- "):
                out[last] = out[last] or []
                out[last].append(_scalar(body[2:]))
                continue
            name, colon, value = body.partition(":")
            if colon and value.strip():
                out[last] = out[last] or {}
                out[last][_scalar(name)] = _scalar(value)
                continue
            raise ValueError(f"not understood: {line!r}")
        name, colon, value = body.partition(":")
        if not colon:
            raise ValueError(f"not understood: {line!r}")
        last = None if value.strip() else str(_scalar(name))
        out[str(_scalar(name))] = _scalar(value) if value.strip() else None
    return out


def _scalar(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def write_simple_yaml(values: dict) -> str:
    """The text that ``simple_yaml`` reads back; texts that look like something else are quoted."""
    def one(x) -> str:
        if isinstance(x, str):
            return x if _scalar(x) == x and not set(x) & set(":#,[]'\"") and x == x.strip() else "'" + x + "'"
        return "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x)

    out = []
    for k, v in values.items():
        if isinstance(v, dict):
            out += [f"{one(k)}:", *[f"  {one(a)}: {one(b)}" for a, b in v.items()]]
        elif isinstance(v, list):
            out += [f"{one(k)}:", *[f"- {one(x)}" for x in v]]
        else:
            out.append(f"{one(k)}: {one(v)}")
    return "\n".join(out) + "\n"
