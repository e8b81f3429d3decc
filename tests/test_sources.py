"""Files in and out: scans, permissive documents, tidy CSV, append logs, writes that never overwrite."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import joins
from gaugeflow.sources import files, images, labels


def test_scan_and_documents(spark, tmp_path):
    (tmp_path / "in/b").mkdir(parents=True)
    contents = {"in/1.JPG": b"x", "in/b/2.json": "﻿".encode() + json.dumps({"version": "1", "shapes": [{"label": "a", "points": [[0, 1], [2, 3], [4, 5]], "shape_type": "polygon"}], "imageWidth": 5}).encode(), "in/b/3.json": b"{broken", "in/b/4.json": b'{"shapes":{"a":1}}', "in/b/5.txt": b""}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    found = {r["relative_path"]: (r["file_type"], r["size_bytes"], r["sha256"]) for r in files.scan(spark, str(tmp_path / "in")).collect()}
    kinds = {"1.JPG": "image", "b/2.json": "json", "b/3.json": "json", "b/4.json": "json", "b/5.txt": "other"}
    assert found == {k: (v, len(contents["in/" + k]), hashlib.sha256(contents["in/" + k]).hexdigest()) for k, v in kinds.items()}
    assert "sha256" not in files.scan(spark, str(tmp_path / "in"), digest=False).columns
    parsed = files.annotations(spark, str(tmp_path / "in")).withColumn("name", files.stem(F.col("path")))
    assert {r["name"]: r["problem"] for r in parsed.collect()} == {"2": None, "3": "json_error", "4": "shapes_not_list"}
    assert [(r["shape_index"], r["label"]) for r in files.shapes(parsed).collect()] == [(0, "a")]
    assert {r["key"]: r["n"] for r in files.key_counts(parsed.where("name <> '3'")).collect()} == {"version": 1, "shapes": 2, "imageWidth": 1}
    issues = files.document_issues(parsed, parsed.select("path", F.lit(6).alias("width"), F.lit(5).alias("height")).where("name = '2'"))
    assert {(r["issue"], r["shape_index"]) for r in issues.collect()} == {("shapes_not_list", None), ("image_dimension_mismatch", None)}


def test_csv_logs_and_frozen_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿ k , v ,flag\n1, 2.5 ,True\n2,oops,\n".encode())
    raw = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert raw.columns == ["k", "v", "flag"] and {(r["k"], r["column"], r["value"]) for r in files.cast_violations(raw, ["k", "v"]).collect()} == {("2", "v", "oops")}
    typed = files.read_csv(spark, str(tmp_path / "a.csv"), "k int, v double, flag string")
    assert sorted((r["k"], r["v"], r["f"]) for r in typed.select("k", "v", files.flag(F.col("flag")).alias("f")).where("k = 1").collect()) == [(1, 2.5, True)]
    assert [r[0] for r in typed.orderBy("k").select(files.rendered(F.col("v"))).collect()] == ["2.5", "N/A"]
    files.write_csv(typed, str(tmp_path / "out"), ["v", "k"])
    assert files.read_csv(spark, str(tmp_path / "out")).columns == ["v", "k"]
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_csv(typed, str(tmp_path / "out"), ["v"])
    for k in (1, 2):
        files.append_jsonl(spark.createDataFrame([(k,)], "k int"), str(tmp_path / "log"))
    assert sorted(r["k"] for r in spark.read.json(str(tmp_path / "log")).collect()) == [1, 2]
    (tmp_path / "run.log").write_text('x\nRESULT={"k":1}\nRESULT={"k":2}\n')
    lines = files.lines(spark, str(tmp_path / "run.log"))
    assert [joins.latest_line(lines, "RESULT", "k int", last=x).first()["k"] for x in (True, False)] == [2, 1]
    rows = spark.createDataFrame([(1, "train"), (2, "val")], "k int, split string")
    note = files.freeze(rows, str(tmp_path / "frozen"), "split", {"source": "here"}).first()
    assert note["rows"] == 2 and note["source"] == "here" and spark.read.parquet(str(tmp_path / "frozen/data")).count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        files.freeze(rows, str(tmp_path / "frozen"), "split", {})
    text = spark.createDataFrame([("train", "0 0 0 1 0 1 1"), ("val", "9 0 0 1 0 1 1")], "split string, line string")
    labels.write(text, str(tmp_path / "labels"), "split")
    assert sorted((r["class_id"], r["problem"]) for r in labels.read(spark, str(tmp_path / "labels"), 2).select("class_id", F.coalesce("problem", F.lit("")).alias("problem")).collect()) == [(0, ""), (9, "class_range")]


def camera_tags(order, tags):
    number = lambda x, n: x.to_bytes(n, "little" if order == b"II" else "big")
    at, data, entries = 8 + 2 + 12 * len(tags) + 4, b"", b""
    for tag, text in tags:
        raw = text.encode() + b"\0"
        entries += number(tag, 2) + number(2, 2) + number(len(raw), 4) + number(at + len(data), 4)
        data += raw
    return order + number(42, 2) + number(8, 4) + number(len(tags), 2) + entries + number(0, 4) + data


def test_camera_dates(spark, tmp_path):
    block = camera_tags(b"II", [(271, "maker"), (306, "2024:01:02 03:04:05")])
    jpeg = b"\xff\xd8\xff\xe0\x00\x04xx\xff\xe1" + (len(block) + 8).to_bytes(2, "big") + b"Exif\0\0" + block + b"\xff\xda"
    png = b"\x89PNG\r\n\x1a\n" + (0).to_bytes(4, "big") + b"IHDR" + b"\0" * 4
    other = camera_tags(b"MM", [(36868, "2024:01:02 03:04:05")])
    png += len(other).to_bytes(4, "big") + b"eXIf" + other + b"\0" * 4
    for name, content in {"a.jpg": jpeg, "b.PNG": png, "c.jpeg": b"\xff\xd8\xff", "d.png": b"", "e.jpg": jpeg[:40], "f.txt": jpeg}.items():
        (tmp_path / name).write_bytes(content)
    assert images.date_tags(jpeg) == images.date_tags(png) == ["2024:01:02 03:04:05"]
    assert [tuple(r) for r in images.date_counts(spark, str(tmp_path)).collect()] == [("2024:01:02 03:04:05", 2)]
