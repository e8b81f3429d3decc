"""Report frames on small tables."""

import json
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import joins, report, split
from gaugeflow.sources import files


def test_latency_joins_by_id(spark):
    images = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, 6.0)], "image int, ms double")
    candidates = spark.createDataFrame([(1, 10.0), (1, 20.0), (3, 1.0)], "image int, ms double")
    row = report.latency(images, candidates, "image", "ms").collect()[0]
    assert (row["first_mean"], row["all_mean"], row["all_median"], row["second_median"]) == (4.0, 43 / 3, 7.0, 10.0)


def test_flags_pages_and_kinds(spark):
    lines = {1: ["0 0 0 1 0 1 1", ""], 2: ["0 0 0 2 0 1 1"], 3: ["9 0 0 1 1 0.5 0.5"], 4: ["0 0 0 1 0 1 1", "0 0 0", "0 0 0 1 0 1 1"], 6: ["0 nan 0 1 0 1 1"]}
    d = spark.createDataFrame([(k, i, x) for k, xs in lines.items() for i, x in enumerate(xs)], "k int, number int, line string")
    images = spark.createDataFrame([(k, k, False, "a", "b", True, True) for k in range(1, 7)], "k int, dataset_index int, is_hard boolean, image_path string, label_path string, image_decode_ok boolean, image_finite boolean")
    found = report.training_rows(images, d, "k", 3)
    assert len(found.columns) == 17
    flags = ("label_parse_ok", "polygon_finite", "coordinate_range_ok", "class_id_ok", "instance_count", "degenerate_polygon_count", "valid_target")
    got = {r["image_stem"]: tuple(r[c] for c in flags) for r in found.collect()}
    assert got == {1: (True, True, True, True, 1, 0, True), 2: (True, True, False, True, 1, 0, False), 3: (True, True, True, False, 1, 1, False), 4: (False, False, False, False, 1, 0, False), 5: (True, True, True, True, 0, 0, False), 6: (True, False, False, True, 1, 0, False)}
    assert tuple(report.training_summary(found).collect()[0]) == (0, 5, 0, 0)
    assert report.pages([("a", 4), ("b", 6), ("c", 1), ("d", 10)]) == [["a", "b"], ["c"], ["d"]]
    kinds = spark.createDataFrame([("docs/a.md",), ("x/b.png",), ("c",)], "p string").select("p", report.document_kind(F.col("p"), [(r"\.md$", "text"), (r"\.png$", "figure")]).alias("k")).collect()
    assert [r["k"] for r in kinds] == ["text", "figure", "other"]


def test_safe_json_and_logs(spark):
    row = spark.createDataFrame([(1, math.nan), (2, 0.5)], "i int, v double").select("i", report.safe_json(F.struct("i", "v"), ["v"]).alias("j")).orderBy("i").collect()
    assert [json.loads(r["j"])["v"] for r in row] == ["NaN", "0.5"]
    lines = spark.createDataFrame([(0, 'R={"a": 1}'), (1, "noise"), (2, 'x R={"a": 2}')], "line int, value string")
    assert joins.latest_line(lines, "R", "a int").collect()[0]["a"] == 2
    assert joins.latest_line(lines, "R", "a int", last=False).collect()[0]["a"] == 1


def test_remap_and_counts(spark):
    images = spark.createDataFrame([("a",), ("b",)], "k string")
    shapes = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 1.0), ("b", 2, 3.0)], "k string, c int, area double").withColumns({"w": F.lit(2.0), "h": F.lit(3.0)})
    assert {r["k"]: r["instances"] for r in report.one_class(images, shapes, "k", "c", 1).collect()} == {"a": 1, "b": 0}
    assert {r["k"]: r["coverage"] for r in report.coverage(shapes, "k", "area", "w", "h").collect()} == {"a": 0.5, "b": 0.5}
    assert tuple(report.label_counts(shapes, "k", "c").collect()[0]) == (1, 1, 2.0)


def test_documents_counters_and_configurations(spark):
    docs = spark.createDataFrame([("a", '{"shapes":[{"l":1},2,null],"imageWidth":5,"imageHeight":4}'), ("b", '{"shapes":{"l":1}}'), ("c", "{}"), ("d", "broken")], "path string, raw string")
    sizes = spark.createDataFrame([("a", 5, 4), ("b", 5, 4), ("c", None, None)], "path string, width int, height int")
    found = {tuple(r) for r in files.document_issues(docs, sizes).collect()}
    assert found == {("a", 1, "shape_not_object"), ("a", 2, "shape_not_object"), ("b", None, "shapes_not_list"), ("b", None, "image_dimension_mismatch")}
    counted = report.counter_json(spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, None)], "k int, l string"), "k", "l")
    assert {r["k"]: r["counts"] for r in counted.collect()} == {1: '{"a":1,"b":2}', 2: '{"null":1}'}
    config = {"path": "/d", "nc": 2, "names": {0: "a b", 1: "true"}, "splits": ["train", "val"], "x": None, "r": 0.5}
    assert files.simple_yaml(files.write_simple_yaml(config)) == config
    with pytest.raises(ValueError):
        files.simple_yaml("a:\n  b:\n    c: 1\n")


def test_stamps_are_one_utc_time(spark):
    got = {r["at"] for r in report.stamped(spark.range(5), "at").collect()}
    assert len(got) == 1 and datetime.strptime(got.pop(), "%Y-%m-%dT%H:%M:%SZ").year >= 2024
    rows = spark.createDataFrame([(str(i), ["a"]) for i in range(5)], "g string, l array<string>")
    with pytest.raises(ValueError, match="groups"):
        split.search_split(rows, "g", "l", {"train": 0.8, "val": 0.2}, most_groups=4)
