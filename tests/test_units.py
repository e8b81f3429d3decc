"""Operators on small tables with results worked out by hand, and properties that must hold for any input."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeflow.functions import exprs
from gaugeflow.operators import dedup, gates, geometry, joins, matching, metrics, profile, sampling, split
from gaugeflow.sources import files, images, labels

PAIR = "image long, gt long, pred long, gt_cls int, pred_cls int, conf double, mask_iou double, box_iou double"


def sequential(pairs, least=0.5, by_class=True):
    used_g, used_p, out = set(), set(), set()
    for iou, g, p, a, b in sorted(((r[6], r[1], r[2], r[3], r[4]) for r in pairs), reverse=True):
        if iou >= least and (a == b or not by_class) and g not in used_g and p not in used_p:
            used_g.add(g)
            used_p.add(p)
            out.add((g, p))
    return out


def test_greedy_ties_and_chains(spark):
    chain = [(1, 0, 0, 0, 0, 0.5, 0.9, 0.0), (1, 0, 1, 0, 0, 0.5, 0.8, 0.0), (1, 1, 0, 0, 0, 0.5, 0.85, 0.0)]
    ties = [(2, g, p, 0, 0, 0.5, 0.7, 0.0) for g in range(2) for p in range(2)]
    other = [(3, 0, 0, 0, 1, 0.5, 0.9, 0.0)]
    found = {(r["image"], r["gt"], r["pred"]) for r in matching.greedy(spark.createDataFrame(chain + ties + other, PAIR)).collect()}
    assert found == {(1, 0, 0), (2, 1, 1), (2, 0, 0)}
    assert matching.greedy(spark.createDataFrame([], PAIR)).count() == 0


def test_greedy_rounds_equal_the_sequential_scan(spark):
    rng = random.Random(3)
    rows = [(image, g, p, rng.randrange(2), rng.randrange(2), 0.5, rng.choice([0.4, 0.5, 0.6, 0.7]), 0.9) for image in range(40) for g, p in itertools.product(range(5), range(5)) if rng.random() < 0.6]
    for by_class in (True, False):
        found = matching.greedy(spark.createDataFrame(rows, PAIR), by_class=by_class).collect()
        for image in range(40):
            assert {(r["gt"], r["pred"]) for r in found if r["image"] == image} == sequential([r for r in rows if r[0] == image], by_class=by_class)


def test_components_do_not_depend_on_order(spark):
    edges = [(1, 2), (2, 3), (5, 4), (3, 9), (7, 8), (8, 6)]
    want = {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6}
    for seed in range(2):
        random.Random(seed).shuffle(edges)
        d = spark.createDataFrame([tuple(e) for e in edges], "left long, right long")
        assert {r["member"]: r["component"] for r in dedup.components(d).collect()} == want
    long = spark.createDataFrame([(i, i + 1) for i in range(200)], "left long, right long")
    assert dedup.components(long).select("component").distinct().collect()[0][0] == 0


def test_bands_lose_no_pair(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(-(2**62), 2**62, 60)
    hashes = [int(b) for b in base] + [int(b) ^ sum(1 << int(k) for k in rng.choice(63, int(n), replace=False)) for b, n in zip(base, rng.integers(0, 9, 60), strict=True)]
    d = spark.createDataFrame([(i, h, h, [1.0, 0.0]) for i, h in enumerate(hashes)], "id long, phash long, dhash long, feature array<double>")
    found = {(r["left"], r["right"]) for r in dedup.near_pairs(d, "id", 6, 8, 0.9).collect()}
    want = {(i, j) for i, j in itertools.combinations(range(len(hashes)), 2) if ((hashes[i] ^ hashes[j]) & (2**64 - 1)).bit_count() <= 6}
    assert found == want and want
    assert {(r["left"], r["right"]) for r in dedup.near_pairs_blocked(d, "id", 6, 8, 0.9, block=16).collect()} == want


def test_runs_across_ranges(spark):
    values = [1, 2, 3, 5, 6, 8, 9, 10, 10, None] + list(range(65530, 65545))
    found = profile.runs(spark.createDataFrame([(v,) for v in values], "v long"), "v")
    assert sorted(map(tuple, found.collect())) == [(1, 3, 3), (8, 10, 3), (65530, 65544, 15)]


def test_even_sample(spark):
    d = spark.createDataFrame([(i,) for i in range(7)], "i long")
    assert sorted(r["place"] for r in profile.even_sample(d, "i", 3).collect()) == [0, 3, 6]
    assert [r["place"] for r in profile.even_sample(d, "i", 1).collect()] == [0]


def test_describe_and_deviation(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 9.0), ("b", None)], "k string, v double")
    got = {r["k"]: r for r in profile.describe(d, "v", ["k"]).collect()}
    assert got["a"]["p25"] == 1.75 and got["a"]["p90"] == pytest.approx(7.5) and got["b"]["n"] == 0 and got["b"]["p25"] is None
    runs = spark.createDataFrame([(1, "x", 2.0), (1, "y", 1.0)], "seed int, model string, v double")
    row = metrics.paired_deltas(runs, "seed", "model", "v", [("x", "y")]).collect()[0]
    assert row["mean"] == 1.0 and row["sd"] is None and row["positive"] == 1


SQUARE = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]]


def test_polygons(spark):
    cases = {
        "square": SQUARE, "closed": [*SQUARE, SQUARE[0]], "repeat": [SQUARE[0], *SQUARE], "bow": [[0.0, 0.0], [2.0, 2.0], [2.0, 0.0], [0.0, 2.0]],
        "two": SQUARE[:2], "nan": [*SQUARE, [math.nan, 1.0]], "short": [*SQUARE, [1.0]], "turned": [*SQUARE[2:], *SQUARE[:2]][::-1], "out": [[-1.0, 0.0], [2.0, 0.0], [2.0, 2.0]],
    }
    d = spark.createDataFrame([(k, i, v, "c", "polygon", 4.0, 4.0) for i, (k, v) in enumerate(cases.items())], "name string, i int, raw array<array<double>>, label string, shape string, w double, h double")
    issues = lambda d, doc: {r["name"]: r["issues"] for r in geometry.with_issues(d, "raw", "label", "shape", "w", "h", doc, "i").collect()}
    flat = ["fewer_than_3_unique_points", "zero_area_polygon"]
    assert issues(d, "name") == {"square": [], "closed": [], "repeat": [], "bow": ["zero_area_polygon", "self_intersection"], "two": flat, "nan": ["nan_or_inf_coordinate"], "short": ["invalid_point_structure"], "turned": [], "out": ["polygon_out_of_bounds"]}
    # in one document all that are squares but the first are duplicates of it, whatever was wrong with their points
    found = issues(d.withColumn("doc", F.lit(1)), "doc")
    assert {k for k, v in found.items() if "duplicate_polygon" in v} == {"closed", "repeat", "nan", "short", "turned"}
    odd = spark.createDataFrame([("null", 0, None, None, None, None, None)], d.schema)
    assert issues(odd, "name") == {"null": ["non_polygon_shape", "empty_label", "invalid_point_structure", *flat]}
    strict = {r["name"]: r for r in geometry.rejects(d, "raw", "shape", "w", "h", "why").select("name", geometry.clean_strict(F.col("raw")).alias("p"), "why").collect()}
    assert len(strict["nan"]["p"]) == 0 and len(strict["closed"]["p"]) == 4 and strict["bow"]["why"] == "degenerate_polygon" and strict["square"]["why"] is None and strict["nan"]["why"] == "fewer_than_3_valid_points"
    keys = {r["name"]: r["key"] for r in d.where("name IN ('square', 'turned')").select("name", geometry.canonical(F.col("label"), geometry.as_points(F.col("raw"))).alias("key")).collect()}
    assert keys["square"] == keys["turned"]


def test_rasters():
    mask = geometry.rasterise([(0, 0), (1, 0), (1, 1), (0, 1)], 5, 4)
    assert mask.all() and geometry.encode_runs(mask) == [0, 20]
    assert geometry.runs_iou([0, 10], [5, 10]) == pytest.approx(5 / 15) and geometry.runs_iou([], []) == 0.0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=60), st.lists(st.booleans(), min_size=1, max_size=60))
def test_run_iou_equals_pixels(a, b):
    n = max(len(a), len(b))
    x, y = (np.array(v + [False] * (n - len(v))) for v in (a, b))
    union = (x | y).sum()
    assert geometry.runs_iou(geometry.encode_runs(x), geometry.encode_runs(y)) == pytest.approx((x & y).sum() / union if union else 0)


def test_label_lines_round_trip(spark):
    p = spark.createDataFrame([(1, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)])], "c int, p array<struct<x:double,y:double>>")
    back = labels.parse_lines(labels.write_lines(p, F.col("c"), F.col("p"), F.lit(4.0), F.lit(4.0)), "line", 2).collect()[0]
    assert back["class_id"] == 1 and back["problem"] is None and [tuple(q) for q in back["points"]] == [(0, 0), (0.5, 0), (0.5, 0.5)]
    bad = {"1 0 0 1": "token_count", "x 0 0 1 0 1 1": "not_a_number", "5 0 0 1 0 1 1": "class_range", "0 0 0 2 0 1 1": "coordinate_range", "0 0 0 1 0 0.5 0": "no_area", "": "token_count"}
    got = {r["line"]: r["problem"] for r in labels.parse_lines(spark.createDataFrame([(k,) for k in bad], "line string"), "line", 2).collect()}
    assert got == bad


def test_split_search_and_fitted_thresholds(spark):
    groups = [(f"g{i}", 1 + i % 3, {"a": (1, 2)} if i % 2 else {"b": (1, 1)}) for i in range(60)]
    ratios = {"train": 0.7, "val": 0.15, "test": 0.15}
    one = split.search(groups, ratios, seed=1, restarts=1, steps=300)
    assert one == split.search(groups, ratios, seed=1, restarts=1, steps=300) and set(one) == {g[0] for g in groups} and set(one.values()) == set(ratios)
    size = {s: sum(g[1] for g in groups if one[g[0]] == s) for s in ratios}
    assert abs(size["train"] / sum(size.values()) - 0.7) < 0.1


def test_pool_ties_by_name(spark):
    images_ = spark.createDataFrame([(i,) for i in (9, 10, 11, 8, 1, 2, 3, 4, 5, 6)], "image long")
    g = spark.createDataFrame([], "image long, gt long, cls int")
    p = spark.createDataFrame([(i, 0, 0, 0.9) for i in (9, 10, 11, 8)], "image long, pred long, cls int, conf double")
    none = spark.createDataFrame([], PAIR)
    pool = lambda tie: {r["image"] for r in matching.hard_pool(images_, g, p, none, none, tie_break=tie).where("is_hard").collect()}
    assert pool("asc") == {10, 11, 8} and pool("desc") == {9, 8, 11}


def test_integrity_joins(spark):
    left = spark.createDataFrame([("a", "x", "x/a.jpg"), ("b", "x", "x/b.jpg"), ("b", "y", "y/b.jpg"), ("c", "x", "x/c.jpg")], "stem string, parent string, path string")
    right = spark.createDataFrame([("A", "z", "z/a.json"), ("b", "y", "y/b.json"), ("d", "x", "x/d.json")], "stem string, parent string, path string")
    assert sorted(map(tuple, joins.unique_pairs(left, right, "stem", "parent", "path").collect())) == [("x/a.jpg", "z/a.json"), ("y/b.jpg", "y/b.json")]
    assert {r["key"]: r["status"] for r in joins.pair_audit(left, right, "stem").collect()} == {"a": "paired", "b": "paired", "c": "left_only", "d": "right_only"}
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, joins.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]


def test_digest_ignores_order_and_partitions(spark):
    d = spark.range(100).withColumn("v", F.when(F.col("id") % 7 > 0, F.col("id") * 2))
    one = gates.table_digest(d.coalesce(1)).collect()[0]
    assert one == gates.table_digest(d.orderBy(F.col("id").desc()).repartition(7)).collect()[0]
    assert one != gates.table_digest(d.where("id > 0")).collect()[0]


def test_weighted_draws_find_their_rows(spark):
    d = spark.createDataFrame([(i, 1 + (i % 3 == 0) * 4) for i in range(5000)], "k long, w int")
    draws = sampling.weighted_draws(d, "k", "w", 6000, "s")
    got = draws.collect()
    assert sorted(r["draw"] for r in got) == list(range(6000))
    assert abs(sum(r["k"] % 3 == 0 for r in got) / 6000 - 5 / 7) < 0.03


def plain_cases(images, categories, wanted, each, cap):
    """The loop as it is defined: scan order, one category after the other."""
    selected = []
    for name in wanted:
        for image in images:
            if image not in selected and name in categories.get(image, ()):
                selected.append(image)
                if sum(name in categories.get(x, ()) for x in selected) >= each:
                    break
    for image in images:
        if len(selected) >= cap:
            break
        if image not in selected:
            selected.append(image)
    return selected[:cap]


def test_case_selection_equals_the_plain_loop(spark):
    rng = random.Random(8)
    for n, share, each, cap in ((120, 0.3, 8, 64), (120, 0.02, 3, 20), (10, 0.5, 8, 64)):
        categories = {i: {c for c in sampling.CASE_ORDER if rng.random() < share} for i in range(n)}
        d = spark.createDataFrame([(i, c) for i, cs in categories.items() for c in cs], "image long, category string")
        images = spark.range(n).withColumnRenamed("id", "image").withColumn("scan", -F.col("image"))
        found = sampling.case_selection(d, images, "image", "scan", each=each, cap=cap)
        assert found == plain_cases(list(range(n))[::-1], categories, sampling.CASE_ORDER, each, cap)


def test_overlay_sample_covers_classes_and_quotas(spark):
    rows = [(i, ("train", "val", "test")[i % 3], ["a"] if i % 11 else ["a", "b"], i % 7) for i in range(90)]
    d = spark.createDataFrame(rows, "k long, split string, labels array<string>, score int")
    quotas = {"train": 5, "val": 3, "test": 2}
    found = sampling.overlay_sample(d, "split", "k", "labels", ["a", "b"], "score", quotas)
    assert len(found) == len(set(found)) == 10 and any(11 * (k // 11) == k for k in found)
    by = {s: [k for k in found if rows[k][1] == s] for s in quotas}
    assert {s: len(v) for s, v in by.items()} == quotas
    # of each split, what is left out scores no more than what the last step took
    for s, taken in by.items():
        rest = [k for k in taken if k not in found[:2]]
        assert min((rows[k][3] for k in rest), default=9) >= max(r[3] for r in rows if r[1] == s and r[0] not in taken)
    with pytest.raises(ValueError):
        sampling.overlay_sample(d, "split", "k", "labels", ["z"], "score", quotas)


def boxes(spark, truth, predictions):
    """Boxes of side 10 at (x, 0), masks that fill them."""
    b = lambda k, d: d.withColumns({"x2": F.col("x1") + 10, "y1": F.lit(0), "y2": F.lit(10)}).withColumns({"mx1": F.col("x1"), "my1": F.col("y1"), "mx2": F.col("x2"), "my2": F.col("y2")})
    g = b("gt", spark.createDataFrame(truth, "image long, gt long, cls int, x1 int"))
    return g, b("pred", spark.createDataFrame(predictions, "image long, pred long, cls int, conf double, x1 int"))


def test_far_prediction_of_the_class_is_a_localisation_failure(spark):
    truth = [(1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0), (4, 0, 0, 0), (5, 0, 0, 0), (6, 0, 0, 0)]
    # far away; of another class; on the spot but of another class; none; near with little confidence; two far ones
    predictions = [(1, 0, 0, 0.9, 500), (2, 0, 1, 0.9, 500), (3, 0, 1, 0.9, 1), (5, 0, 0, 0.1, 2), (6, 3, 0, 0.9, 400), (6, 2, 0, 0.9, 500)]
    g, p = boxes(spark, truth, predictions)
    pairs = matching.candidates(g, p)
    base = matching.greedy(pairs.where("conf >= 0.25"))
    got = {r["image"]: (r["category"], r["pred"], r["mask_iou"]) for r in matching.fn_taxonomy(g, p, pairs, base).collect()}
    nine = pytest.approx(9 / 11)
    assert got == {1: ("LOCALIZATION_FAILURE", 0, 0.0), 2: ("NO_RESPONSE", None, None), 3: ("WRONG_CLASS", 0, nine), 4: ("NO_RESPONSE", None, None), 5: ("LOW_CONF_RECOVERABLE", 0, pytest.approx(8 / 12)), 6: ("LOCALIZATION_FAILURE", 2, 0.0)}
    kept = p.where("conf >= 0.25")
    pool = {r["image"]: r["score"] for r in matching.hard_pool(g, g, kept, pairs.where("conf >= 0.25"), base).collect()}
    assert pool == {1: 3, 2: 4, 3: 3, 4: 3, 5: 3, 6: 4}
    agnostic = matching.greedy(pairs, by_class=False)
    found = {(r["image"], r["side"], r["index"]): r["category"] for r in matching.agnostic_taxonomy(g, p, pairs, agnostic).collect()}
    assert found[1, "gt", 0] == "low_box_iou" and found[2, "gt", 0] == "FN_no_same_class_candidate" and found[3, "gt", 0] == "wrong_class" and found[5, "gt", 0] == "TP" and found[6, "pred", 3] == "FP_unmatched"


def test_masks_and_boxes_are_judged_apart(spark):
    g, p = boxes(spark, [(1, 0, 0, 0), (2, 0, 0, 0)], [(1, 0, 0, 0.9, 0), (2, 0, 1, 0.9, 0)])
    p = p.withColumn("my2", F.lit(4))  # the mask fills four of ten rows
    pairs = matching.candidates(g, p)
    assert {(r["image"], r["mask_iou"], r["box_iou"]) for r in pairs.collect()} == {(1, 0.4, 1.0), (2, 0.4, 1.0)}
    none = matching.greedy(pairs)
    assert none.count() == 0
    got = {r["image"]: r["category"] for r in matching.fn_taxonomy(g, p, pairs, none).collect()}
    assert got == {1: "LOCALIZATION_FAILURE", 2: "WRONG_CLASS"}
    assert {r["category"] for r in matching.agnostic_taxonomy(g.where("image = 1"), p.where("image = 1"), pairs, none).where("side = 'gt'").collect()} == {"low_mask_iou"}
    runs = lambda *x: F.array(*[F.lit(v) for v in x])
    pairs = matching.candidates(g.withColumn("runs", runs(0, 10)), p.withColumn("runs", runs(5, 10)))
    assert [r["mask_iou"] for r in pairs.collect()] == [pytest.approx(5 / 15)] * 2
    tags = matching.image_categories(matching.test_taxonomy(g, p, pairs, none), g, g.select("image", "gt", F.lit("tiny").alias("bin")))
    assert {tuple(r) for r in tags.collect()} == {(1, "LOCALIZATION_FAILURE"), (1, "FP"), (1, "TINY_SMALL_MISS"), (2, "WRONG_CLASS"), (2, "FP"), (2, "TINY_SMALL_MISS")}


def test_strict_joins_and_split_domain(spark):
    a, b = spark.createDataFrame([(0, "x"), (1, "y")], "o int, a string"), spark.createDataFrame([(1, 5), (0, 4)], "o int, b int")
    assert sorted(map(tuple, joins.zipped(a, b, "o").collect())) == [(0, "x", 4), (1, "y", 5)]
    for bad in (b.where("o = 0"), b.unionByName(b), b.unionByName(spark.createDataFrame([(2, 1)], b.schema))):
        with pytest.raises(Exception, match="no one partner"):
            joins.zipped(a, bad, "o").collect()
    s = spark.createDataFrame([(1, "train"), (2, "val")], "k int, s string")
    assert [r["k"] for r in profile.of_split(s, "s", "val").collect()] == [2]
    with pytest.raises(Exception, match="unknown split"):
        profile.of_split(s.withColumn("s", F.lit("dev")), "s", "val").collect()
    sets = spark.createDataFrame([(1, ["a"]), (1, ["a", "b"]), (2, ["a"]), (2, ["b"]), (3, []), (3, ["a"])], "g int, l array<string>")
    assert {r["g"]: r["subset_relation"] for r in joins.subset_groups(sets, "g", "l").collect()} == {1: True, 2: False, 3: False}


def test_rules(spark):
    d = spark.createDataFrame([(3, 0.1), (2, 0.1), (1, -0.1), (2, -0.1), (1, 0.1)], "p int, m double")
    assert [r[0] for r in d.select(metrics.seed_rule(F.col("p"), F.col("m"))).collect()] == ["HARD_MINING_STRONG_ROBUST_POSITIVE", "HARD_MINING_ROBUST_POSITIVE", "HARD_MINING_NOT_CONFIRMED", "HARD_MINING_UNSTABLE", "HARD_MINING_UNSTABLE"]
    one = lambda c: spark.range(1).select(c).collect()[0][0]
    lit = F.lit
    assert [one(metrics.delta_rule(lit(x), lit(r), lit(0.5))) for x, r in ((0.005, 0.48), (0.005, 0.47), (-0.005, 0.5), (0.0, 0.5))] == ["POSITIVE_CANDIDATE", "NO_CLEAR_GAIN", "NEGATIVE", "NO_CLEAR_GAIN"]
    assert [one(metrics.second_stage_rule(lit(x), lit(0.5))) for x in (0.53, 0.51, 0.4)] == ["POSITIVE_CANDIDATE", "TRADEOFF_ONLY", "NEGATIVE"]
    assert [one(metrics.roi_rule(lit(x), lit(w))) for x, w in ((0.1, 0.0), (0.1, -0.2), (-0.005, 0.0), (-0.1, 0.0))] == ["SUPCON_POSITIVE", "NEGATIVE", "NO_CLEAR_GAIN", "NEGATIVE"]
    names = ["a.conv.weight", "b.weight", "c.bn.weight", "c.bn.bias", "d.running_mean", "d.running_var", "e.num_batches_tracked", "f.bias"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(exprs.tensor_category(F.col("n"))).collect()]
    assert got == ["conv_weight", "conv_weight", "bn_weight", "bn_bias", "bn_running_mean", "bn_running_var", "bn_num_batches_tracked", "other"]


def test_language_audit_limits(spark):
    texts = {"empty": "", "zh": "\u3400" * 7 + " a b c", "en": "\u4e00" * 3 + " a_1 b.c d-e f g h i", "mixed": "\u4e00\u4e00 ab c"}
    d = spark.createDataFrame([(k, v, "docs/exp1.md") for k, v in texts.items()], "k string, t string, p string")
    got = {r["k"]: (r["language"], r["n_zh"], r["n_en"], r["action"]) for r in profile.language_audit(d, "t", "p").collect()}
    keep, make = "keep_original_reference_from_zh_hub", "keep_original_create_zh_companion"
    assert got == {"empty": ("mixed", 0, 0, keep), "zh": ("zh-dominant", 7, 3, keep), "en": ("en-dominant", 3, 7, make), "mixed": ("mixed", 2, 2, make)}


def test_duplicate_context_and_values(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, "g", "a"), (3, "g", "a"), (4, "h", "a"), (5, "h", "b")], "k int, g string, l string")
    got = {r["k"]: r["duplicate_context"] for r in matching.duplicate_context(rows, "g", "l").collect()}
    assert got == {1: "singleton", 2: "near_same_label", 3: "near_same_label", 4: "near_cross_label", 5: "near_cross_label"}
    docs = spark.createDataFrame([('{"v":[1,"x",1]}',), ('{"v":"abc"}',), ('{"v":null}',), ("{}",), ("not json",), ('{"v":{"a":1}}',)], "j string")
    found = {(r["part"], r["value"]): r["n"] for r in profile.value_profile(docs, "j", "v").collect()}
    assert found["type", "array"] == 1 and found["type", "missing"] == 2 and found["type", "null"] == 1 and found["length", "3"] == 2 and found["value", "1"] == 2 and found["value", "abc"] == 1


def test_tensor_and_config_diff(spark):
    a = spark.createDataFrame([("x", [1.0, 2.0]), ("y", [1.0]), ("z", [1.0])], "name string, v array<double>")
    b = spark.createDataFrame([("x", [1.0, 3.0]), ("y", [1.0, 2.0]), ("w", [1.0])], "name string, v array<double>")
    got = {r["name"]: (r["status"], r["max_abs"]) for r in metrics.tensor_diff(a, b, "name", "v").collect()}
    assert got == {"x": ("different", 1.0), "y": ("shape_mismatch", None), "z": ("missing", None), "w": ("unexpected", None)}
    empty = metrics.tensor_stats(spark.createDataFrame([(1, [])], "i int, v array<double>"), "v").collect()[0]
    assert empty["finite_ratio"] == 1.0 and empty["lowest"] is None


def test_files(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    good = {"version": "1", "shapes": [{"label": "a", "points": SQUARE, "shape_type": "polygon"}], "imagePath": "a.png"}
    (folder / "a.json").write_text("﻿" + json.dumps(good), encoding="utf-8")
    (folder / "bad.json").write_text("{nope")
    (folder / "sub" / "list.json").write_text('{"shapes": 3}')
    (folder / "a.PNG").write_bytes(b"no image")
    kinds = {r["relative_path"]: r["file_type"] for r in files.scan(spark, str(folder)).collect()}
    assert kinds == {"a.json": "json", "bad.json": "json", "sub/list.json": "json", "a.PNG": "image"}
    parsed = files.annotations(spark, str(folder))
    problems = {r["path"].rsplit("/", 1)[1]: r["problem"] for r in parsed.collect()}
    assert problems["a.json"] is None and problems["bad.json"] == "json_error" and problems["list.json"] is not None
    shape = files.shapes(parsed).collect()
    assert len(shape) == 1 and shape[0]["label"] == "a" and len(shape[0]["points"]) == 4
    (tmp_path / "x.csv").write_text("﻿epoch, loss \n1, 0.5\n2, oops\n", encoding="utf-8")
    raw = files.read_csv(spark, str(tmp_path / "x.csv"))
    assert raw.columns == ["epoch", "loss"] and [r["value"] for r in files.cast_violations(raw, ["epoch", "loss"]).collect()] == ["oops"]
    assert [r["loss"] for r in files.read_csv(spark, str(tmp_path / "x.csv"), "epoch int, loss double").collect()] == [0.5, None]
    record = files.freeze(spark.range(4).withColumn("split", F.lit("train")), str(tmp_path / "out"), "split", {"source": "test"}).collect()[0]
    assert record["rows"] == 4 and record["source"] == "test"
    with pytest.raises(Exception, match="(?i)exist"):
        files.freeze(spark.range(4).withColumn("split", F.lit("train")), str(tmp_path / "out"), "split", {})


def test_image_failures_and_fingerprints(spark, tmp_path):
    import struct
    import zlib

    def png(rows):
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        raw = b"".join(b"\0" + bytes(r) for r in rows)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    grid = np.random.default_rng(4).integers(20, 230, (5, 6))
    ramp = np.kron(grid, np.ones((8, 8), int)).tolist()
    (tmp_path / "a.png").write_bytes(png(ramp))
    (tmp_path / "b.png").write_bytes(png([[min(255, v + 3) for v in r] for r in ramp]))
    (tmp_path / "c.png").write_bytes(b"broken")
    got = {r["path"].rsplit("/", 1)[1]: r for r in images.with_fingerprints(images.read(spark, str(tmp_path))).collect()}
    assert got["c.png"]["failed"] and got["c.png"]["phash"] is None and got["a.png"]["width"] == 48
    assert ((got["a.png"]["phash"] ^ got["b.png"]["phash"]) & (2**64 - 1)).bit_count() <= 6
    assert ((got["a.png"]["dhash"] ^ got["b.png"]["dhash"]) & (2**64 - 1)).bit_count() <= 8
    assert np.dot(got["a.png"]["feature"], got["b.png"]["feature"]) > 0.98


def test_scalar_expressions(spark):
    row = spark.range(1).select(
        exprs.ratio(F.lit(1), F.lit(0)).alias("zero"), exprs.hamming(F.lit(-1), F.lit(0)).alias("all"), exprs.hex64(F.lit(255)).alias("hex"),
        exprs.bits_to_long(F.array(*[F.lit(i in (0, 63)) for i in range(64)])).alias("bits"), exprs.padded_box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(10), F.lit(10)).alias("box"),
    ).collect()[0]
    assert row["zero"] == 0.0 and row["all"] == 64 and row["hex"] == "00000000000000ff" and row["bits"] == -(2**63) + 1 and tuple(row["box"]) == (0, 0, 2, 2)


BOXES = "image long, {} long, cls int, {}x1 double, y1 double, x2 double, y2 double"


def test_sweep_equals_a_scan_at_every_threshold(spark):
    """A hot image whose boxes all overlap, so that matches at one threshold differ from those at the next; 70 thresholds take two passes."""
    rng = random.Random(5)
    box = lambda: (x := float(rng.randrange(4)), 0.0, x + 10, 10.0)
    g = [(i, k, rng.randrange(2), *box()) for i, n in ((1, 25), (2, 6), (3, 1)) for k in range(n)]
    p = [(i, k, rng.randrange(2), rng.randrange(10) / 10, *box()) for i, n in ((1, 30), (2, 5), (4, 2)) for k in range(n)]
    iou = lambda a, b: (w := max(0.0, min(a[2], b[2]) - max(a[0], b[0]))) * 10 / (200 - w * 10)
    thresholds = [0.0, 0.2, 0.5, 0.9, 0.95] + [0.01 * k + 0.001 for k in range(65)]
    found = matching.sweep(spark.createDataFrame(g, BOXES.format("gt", "")), spark.createDataFrame(p, BOXES.format("pred", "conf double, ")), thresholds)
    got = {(r["threshold"], r["cls"]): (r["tp"], r["fp"], r["fn"]) for r in found.collect()}
    want = {}
    for t in thresholds:
        kept = [r for r in p if r[3] >= t]
        hits = [(i, a, b) for i in (1, 2) for a, b in sequential([(i, x[1], y[1], x[2], y[2], y[3], iou(x[3:], y[4:])) for x in g for y in kept if x[0] == y[0] == i])]
        cls = {(r[0], r[1]): r[2] for r in g}
        for c in (-1, 0, 1):
            tp = sum(c in (-1, cls[i, a]) for i, a, _ in hits)
            want[t, c] = (tp, sum(c in (-1, r[2]) for r in kept) - tp, sum(c in (-1, r[2]) for r in g) - tp)
    assert got == want


def test_sweep_does_not_multiply_pairs_by_thresholds(spark, sf_dir, monkeypatch):
    """What the sweep writes grows with the pairs, not with pairs times thresholds; the boxes are dealt once, by image."""
    from gaugeflow.plans import fixtures as fx

    written, plans, write = [], [], matching.materialise

    def counted(df, *args, **kw):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = write(df, *args, **kw)
        written.append(out.count())
        return out

    g, p = fx.truth(spark, sf_dir), fx.predictions(spark, sf_dir)
    pairs = matching.candidates(g, p).where("mask_iou >= 0.5 and gt_cls = pred_cls").count()
    monkeypatch.setattr(matching, "materialise", counted)
    matching.sweep(g, p, [0.001, 0.005, 0.01, 0.05, 0.1, 0.15, 0.25, 0.35, 0.5, 0.6, 0.75, 0.9]).collect()
    assert pairs > 1000 and sum(written) < 1.5 * pairs
    assert plans[0].count("Exchange hashpartitioning") == plans[0].count("Exchange hashpartitioning(l_orderkey") == 2


def test_recommended_thresholds_write_less_than_the_items(spark, sf_dir, monkeypatch):
    from gaugeflow.plans import fixtures as fx
    from gaugeflow.plans.queries import QUERIES

    written, write = [], matching.materialise

    def counted(df, *args, **kw):
        out = write(df, *args, **kw)
        written.append(out.count())
        return out

    monkeypatch.setattr(matching, "materialise", counted)
    row = QUERIES["q21_f1_best_recall95"](spark, sf_dir).collect()
    assert len(row) == 1 and sum(written) <= fx.items(spark, sf_dir).count()


def test_sweep_shuffles_a_slice_of_the_images_at_a_time(spark, sf_dir, monkeypatch):
    """Slices partition the pairs and change no result; they are cut before the shuffle, and no write leaves its shuffle files behind."""
    from gaugeflow.plans import fixtures as fx
    from gaugeflow.plans.queries import THRESHOLDS

    written, plans, grown, write = [], [], [], matching.materialise
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return sum("/shuffle_" in f for f in manager.getAllFiles().mkString("\n").split("\n"))

    def counted(df, *args, **kw):
        plan, before = df._jdf.queryExecution().executedPlan().toString(), shuffled()
        out = write(df, *args, **kw)
        if "won" in df.columns and "live" in df.columns:
            plans.append(plan)
            grown.append(shuffled() - before)
            written.append(out.count())
        return out

    g, p = fx.truth(spark, sf_dir), fx.predictions(spark, sf_dir)
    monkeypatch.setattr(matching, "materialise", counted)
    whole = sorted(map(tuple, matching.sweep(g, p, THRESHOLDS).collect()))
    n, rounds = written[0], len(written)
    written.clear()
    assert whole == sorted(map(tuple, matching.sweep(g, p, THRESHOLDS, slice_rows=3_000).collect()))
    slices = len(written) - rounds + 1
    assert slices >= 3 and sum(written[:slices]) == n and max(written[:slices]) < 2 * n / slices
    assert all(x.count("Filter ((pmod(xxhash64(l_orderkey") == 2 for x in plans[rounds : rounds + slices])
    assert max(grown) <= 0


def test_split_search_has_no_bound_on_groups(spark):
    """More groups than once were allowed; and, on few, what ``search`` finds over names."""
    ratios = {"train": 0.7, "val": 0.15, "test": 0.15}
    many = spark.range(500_001).select(F.col("id").alias("g"), F.when(F.col("id") % 1000 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("l"))
    found = {r["split"]: (r["n"], r["a"]) for r in split.search_split(many, "g", "l", ratios, restarts=1, steps=10).groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("g") % 1000 == 0).alias("a")).collect()}
    assert sum(n for n, _ in found.values()) == 500_001 and sum(a for _, a in found.values()) == 501
    assert all(abs(found[s][0] / 500_001 - share) < 0.01 and abs(found[s][1] / 501 - share) < 0.01 for s, share in ratios.items())
    rows = [(f"g{i % 97}", ["a"] * (i % 3) + ["b"] * (i % 5 == 0)) for i in range(300)]
    own: dict = {}
    for g, labels_ in rows:
        size, classes = own.get(g, (0, {}))
        own[g] = size + 1, classes | {c: (classes.get(c, (0, 0))[0] + 1, classes.get(c, (0, 0))[1] + labels_.count(c)) for c in labels_}
    want = split.search([(g, n, dict(sorted(c.items()))) for g, (n, c) in own.items()], ratios, steps=200)
    got = split.search_split(spark.createDataFrame(rows, "g string, l array<string>"), "g", "l", ratios, steps=200)
    assert sorted(map(tuple, got.collect())) == sorted(want.items())
