"""The registered queries of the audit and evaluation operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.functions.exprs import padded_box, ratio, similarity_hint, tensor_category
from gaugeflow.operators import dedup, gates, geometry, joins, matching, metrics, profile, report, sampling, split
from gaugeflow.operators.ranking import global_place
from gaugeflow.plans import fixtures as fx
from gaugeflow.session import materialise
from gaugeflow.sources import files

QUERIES: dict = {}
THRESHOLDS = [0.001, 0.005, 0.01, 0.05, 0.1, 0.15, 0.25, 0.35, 0.5, 0.6, 0.75, 0.9]


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def q01_class_stats(spark: SparkSession, d: str) -> DataFrame:
    """D2 over events: image = user, class = type, area = value; tiny under 5."""
    return profile.class_statistics(fx.table(spark, d, "events"), "user_id", "event_type", "value", 5.0)


@query
def q01_shape_stats(spark: SparkSession, d: str) -> DataFrame:
    """Classes of the polygons, with medians of vertices, relative area and aspect; tiny under 1 % of the image."""
    m = _measured(spark, d).withColumns({"vertices": F.size("points"), "relative_area": F.col("area") / (F.col("width") * F.col("height"))})
    found = profile.class_statistics(m, "image", "label", "relative_area", 0.01, ("vertices", "relative_area", "aspect"))
    return found.select("class", "images", "instances", "tiny", "median_vertices", *[F.round(c, 9).alias(c) for c in ("image_share", "instance_share", "tiny_share", "median_relative_area", "median_aspect")])


@query
def q02_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """D3: types of a user together, full grid."""
    return profile.cooccurrence(fx.table(spark, d, "events"), "user_id", "event_type")


@query
def q03_describe(spark: SparkSession, d: str) -> DataFrame:
    """Prices by return flag."""
    return profile.describe(fx.table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"])


@query
def q04_instances_hist(spark: SparkSession, d: str) -> DataFrame:
    """Line items an order, orders without included."""
    return profile.children_histogram(fx.table(spark, d, "orders"), fx.table(spark, d, "lineitem"), "o_orderkey", "l_orderkey")


@query
def q05_exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Documents of equal text."""
    return dedup.exact_groups(fx.table(spark, d, "documents"), "text", "doc_id")


@query
def q06_near_pairs(spark: SparkSession, d: str) -> DataFrame:
    """C5 with the default thresholds, by bit bands, over the vectors and planted near copies."""
    return _rounded(dedup.near_pairs(fx.prints_with_copies(spark, d), "vec_id"))


@query
def q06_near_pairs_relaxed(spark: SparkSession, d: str) -> DataFrame:
    """C5 with Hamming at most 24 and correlation at least 0.35, in blocks."""
    return _rounded(dedup.near_pairs(fx.prints(spark, d), "vec_id", 24, 64, 0.35))


def _rounded(pairs: DataFrame) -> DataFrame:
    return pairs.select("left", "right", "phash_distance", "dhash_distance", F.round("correlation", 6).alias("correlation"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    exact = dedup.exact_groups(fx.table(spark, d, "documents"), "text", "doc_id")
    star = exact.join(exact.groupBy("group_id").agg(F.min("doc_id").alias("left")), "group_id").where(F.col("doc_id") != F.col("left")).select("left", F.col("doc_id").alias("right"))
    return dedup.near_pairs(fx.prints(spark, d), "vec_id", 24, 64, 0.35).select("left", "right").unionByName(star)


@query
def q07_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of near and exact edges, ranked by size."""
    found = dedup.components(_edges(spark, d))
    return dedup.ranked_groups(found, "component", "member", "near").select("group_id", "size", "member")


@query
def q08_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Labels within groups of equal documents; a document without labels is <NO_JSON>."""
    groups = dedup.exact_groups(fx.table(spark, d, "documents"), "text", "doc_id").select("group_id", "doc_id")
    labels = fx.table(spark, d, "labels")
    notes = labels.select("doc_id", F.explode(F.array(F.concat(F.lit("quality"), F.col("quality").cast("string")), F.concat(F.lit("toxic"), F.col("toxic").cast("string")))).alias("label"))
    return dedup.group_consistency(groups, notes, "group_id", "doc_id", "label")


@query
def q09_pair_audit(spark: SparkSession, d: str) -> DataFrame:
    """Documents against labels."""
    return joins.pair_audit(fx.table(spark, d, "documents"), fx.table(spark, d, "labels"), "doc_id")


@query
def q10_numeric_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of consecutive labelled ids."""
    return profile.runs(fx.table(spark, d, "labels"), "doc_id")


@query
def q11_even_sample(spark: SparkSession, d: str) -> DataFrame:
    """Twenty evenly spaced documents."""
    return profile.even_sample(fx.table(spark, d, "documents").select("doc_id", "source"), "doc_id", 20)


@query
def q12_nearest_labeled(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of labels 8 and 9 against the rest."""
    prints, labels = fx.prints(spark, d), fx.table(spark, d, "embeddings").select("vec_id", "label")
    asked = prints.join(labels.where(F.col("label").isin(8, 9)), "vec_id", "left_semi")
    rest = prints.join(labels.where(~F.col("label").isin(8, 9)), "vec_id", "left_semi")
    found = dedup.nearest(asked, rest, "vec_id")
    return found.select("left", "right", "phash_distance", "dhash_distance", F.round("correlation", 6).alias("correlation"), similarity_hint(F.col("phash_distance"), F.col("dhash_distance"), F.col("correlation")).alias("hint"))


def _measured(spark: SparkSession, d: str) -> DataFrame:
    p = fx.polygons(spark, d).withColumn("points", geometry.as_points(F.col("quad")))
    p = p.withColumns({"area": geometry.area(F.col("points")), "box": geometry.bounds(F.col("points"))})
    return p.withColumns({"box_area": (F.col("box.x2") - F.col("box.x1")) * (F.col("box.y2") - F.col("box.y1")), "aspect": geometry.aspect(F.col("box")), "split": fx.split_of()})


@query
def q13_polygon_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Area, box and aspect of the polygons."""
    m = _measured(spark, d)
    return m.select("image", "gi", F.size("points").alias("vertices"), "area", "box_area", F.round("aspect", 6).alias("aspect"), F.round(F.col("area") / (F.col("width") * F.col("height")), 9).alias("relative_area"))


@query
def q14_polygon_issues(spark: SparkSession, d: str) -> DataFrame:
    """Every issue of every shape, a row each; every fifth shape has a reversed copy in its document."""
    p = fx.polygons(spark, d)
    copies = p.where(F.col("gi") % 5 == 1).withColumns({"gi": F.col("gi") + 100, "raw": F.reverse("raw")})
    found = geometry.with_issues(p.unionByName(copies), "raw", "label", "shape_type", "width", "height", "image", "gi")
    # explode would have the planner test the array for emptiness below the projections, and so compute all of them over again
    return found.select("image", "gi", F.explode_outer("issues").alias("issue")).where(F.col("issue").isNotNull())


@query
def q14_conversion_rejects(spark: SparkSession, d: str) -> DataFrame:
    """K2: the first reason why a shape cannot be converted, in counts."""
    found = geometry.rejects(fx.polygons(spark, d), "raw", "shape_type", "width", "height")
    return found.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("shapes"))


@query
def q15_canonical_dups(spark: SparkSession, d: str) -> DataFrame:
    """Copies of polygons, rotated and reversed, found by their canonical key."""
    p = fx.polygons(spark, d).withColumn("points", geometry.as_points(F.col("quad"))).select("image", "gi", "label", "points")
    turned = F.reverse(F.concat(F.slice("points", 2, 3), F.slice("points", 1, 1)))
    copies = p.where(F.col("gi") % 3 == 0).select("image", (F.col("gi") + 100).alias("gi"), "label", turned.alias("points"))
    keyed = p.unionByName(copies).withColumn("key", geometry.canonical(F.col("label"), F.col("points")))
    return geometry.repeated(keyed, "image", "key", "gi").select("image", "gi", "occurrence")


def _split_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents with group (of equal texts), hashed split and labels."""
    docs = fx.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    first = docs.groupBy("sha").agg(F.min("doc_id").alias("component"), F.count("*").alias("n"))
    rows = docs.join(first, "sha").withColumn("group", split.group_of(F.when(F.col("n") > 1, F.col("component")), F.col("doc_id")))
    labels = fx.table(spark, d, "labels")
    notes = F.when(F.col("quality").isNotNull(), F.array(F.concat(F.lit("quality"), F.col("quality").cast("string")), F.concat(F.lit("toxic"), F.col("toxic").cast("string")))).otherwise(F.array().cast("array<string>"))
    return rows.join(labels, "doc_id", "left").select("doc_id", "sha", "group", split.hashed_split(F.col("group")).alias("split"), notes.alias("labels"))


@query
def q16_split_profile(spark: SparkSession, d: str) -> DataFrame:
    """Images and instances by split and class."""
    return split.profile(_split_rows(spark, d), "split", "doc_id", "labels")


@query
def q16_split_objective(spark: SparkSession, d: str) -> DataFrame:
    """The cost of the hashed split."""
    return split.objective(split.profile(_split_rows(spark, d), "split", "doc_id", "labels"), {"train": 0.7, "val": 0.15, "test": 0.15})


@query
def q17_train_only_bins(spark: SparkSession, d: str) -> DataFrame:
    """Size bins from train's quartiles, applied to every split; empty bins appear."""
    binned = matching.binned(_measured(spark, d).select("split", "area"))
    grid = spark.createDataFrame([(s, b) for s in split.SPLITS for b in ("tiny", "small", "medium", "large")], "split string, bin string")
    return grid.join(binned.groupBy("split", "bin").agg(F.count("*").alias("shapes")), ["split", "bin"], "left").na.fill(0, ["shapes"])


def _boxes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    g, p = fx.truth(spark, d), fx.predictions(spark, d)
    return g, p, matching.candidates(g, p)


@query
def q18_greedy_match(spark: SparkSession, d: str) -> DataFrame:
    """One-to-one matches within a class, with both IoUs."""
    return matching.greedy(_boxes(spark, d)[2]).select("image", "gt", "pred", *[F.round(c, 9).alias(c) for c in ("mask_iou", "box_iou")])


@query
def q19_agnostic_match(spark: SparkSession, d: str) -> DataFrame:
    """Class-blind matches and both taxonomies, in counts by class."""
    g, p, c = _boxes(spark, d)
    m = materialise(matching.greedy(c, by_class=False), "agnostic")
    return matching.agnostic_taxonomy(g, p, c, m).groupBy("side", "cls", "category").agg(F.count("*").alias("n"))


def _sweep(spark: SparkSession, d: str) -> DataFrame:
    g, p, _ = _boxes(spark, d)
    return matching.sweep(g, p, THRESHOLDS)


@query
def q20_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Scores at twelve thresholds, over all and by class."""
    return _sweep(spark, d).select("threshold", "cls", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query
def q21_f1_best_recall95(spark: SparkSession, d: str) -> DataFrame:
    """The thresholds that the sweep recommends."""
    return matching.sweep_choice(_sweep(spark, d)).select("best_f1_threshold", F.round("best_f1", 9).alias("best_f1"), "recall95_threshold")


def _base_match(spark: SparkSession, d: str, conf: float = 0.25) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    g, p, c = _boxes(spark, d)
    return g, p, c, materialise(matching.greedy(c.where(F.col("conf") >= conf)), "base")


@query
def q22_fn_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """What became of every ground truth missed at confidence 0.25."""
    g, p, c, m = _base_match(spark, d)
    return matching.fn_taxonomy(g, p, c, m).select("image", "gt", "cls", "category", "pred", *[F.round(x, 9).alias(x) for x in ("mask_iou", "box_iou")], "conf")


def _tested(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g, p, c, m = _base_match(spark, d)
    kept = F.col("conf") >= 0.25
    return g, matching.test_taxonomy(g, p.where(kept), c.where(kept), m)


@query
def q23_test_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Categories of ground truth and false alarms at confidence 0.25, in counts by class."""
    return _tested(spark, d)[1].groupBy("side", "cls", "category").agg(F.count("*").alias("n"))


def _categories(spark: SparkSession, d: str) -> DataFrame:
    g, kinds = _tested(spark, d)
    areas = g.withColumns({"area": (F.col("mx2") - F.col("mx1")) * (F.col("my2") - F.col("my1")), "split": fx.split_of()})
    return matching.image_categories(kinds, g, matching.binned(areas).select("image", "gt", "bin"))


@query
def q23_image_categories(spark: SparkSession, d: str) -> DataFrame:
    """Images by category, with the tags of small misses and of scenes with several defects."""
    return _categories(spark, d).groupBy("category").agg(F.count("*").alias("images"))


@query
def q23_bottom_classes(spark: SparkSession, d: str) -> DataFrame:
    """The two classes of lowest recall at confidence 0.25."""
    g, p, c, m = _base_match(spark, d)
    scores = matching.fixed_point(g.select("cls"), p.where(F.col("conf") >= 0.25).select("cls"), m.select(F.col("gt_cls").alias("cls")), ["cls"])
    return metrics.bottom_classes(scores, "recall", "cls", 2).select("place", "cls", "tp", "fp", "fn", F.round("recall", 9).alias("recall"))


def _pool(spark: SparkSession, d: str) -> DataFrame:
    g, p, c, m = _base_match(spark, d)
    kept = F.col("conf") >= 0.25
    return matching.hard_pool(g, g, p.where(kept), c.where(kept), m)


@query
def q24_hard_pool(spark: SparkSession, d: str) -> DataFrame:
    """Hard scores, and the top 30 per cent, ties by name upwards."""
    return _pool(spark, d)


@query
def q25_hard_pool_presence(spark: SparkSession, d: str) -> DataFrame:
    """Classes in the hard pool, and its scores' ends."""
    labels = joins.ordered_labels(fx.truth(spark, d).withColumn("name", F.concat(F.lit("class"), F.col("cls").cast("string"))), "image", "cls", "name")
    hard = _pool(spark, d).where("is_hard").join(labels, "image")
    return hard.select("image", "score", F.explode(F.split("labels", "[|]")).alias("label")).groupBy("label").agg(F.countDistinct("image").alias("images"), F.min("score").alias("lowest"), F.max("score").alias("highest"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Mean value by six-day seed and type."""
    e = fx.table(spark, d, "events").where(F.col("event_type").isin("click", "view", "purchase"))
    seed = F.floor((F.dayofmonth("ts") - 1) / 6)
    return e.groupBy(seed.alias("seed"), F.col("event_type").alias("model")).agg(F.round(F.avg("value"), 6).alias("metric"))


EFFECTS = [("view", "click"), ("purchase", "view"), ("purchase", "click")]


@query
def q26_paired_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Differences of three models paired by seed."""
    return metrics.paired_deltas(_runs(spark, d), "seed", "model", "metric", EFFECTS)


@query
def q27_decision_rule(spark: SparkSession, d: str) -> DataFrame:
    """What the paired differences say, by every rule that reads two numbers and a guard."""
    e = metrics.paired_deltas(_runs(spark, d), "seed", "model", "metric", EFFECTS)
    seeds = metrics.seed_rule(F.col("positive"), F.col("mean"), 5)
    recovery = metrics.recovery_rule(F.col("positive"), F.col("n") * 2)
    delta = metrics.delta_rule(F.col("mean") / 10, F.col("highest"), F.col("lowest") + 1)
    one = metrics.one_class_rule(F.col("highest"), F.lit(0.5), F.col("mean"), F.col("lowest"))
    second = metrics.second_stage_rule(F.col("highest"), F.col("sd"))
    roi = metrics.roi_rule(F.col("mean"), F.col("lowest") / 10)
    cause = metrics.cause_rule(F.col("mean") > 0, F.col("highest") > 0.5, F.col("lowest") > 0, F.when(F.col("n") > 3, F.col("sd") < 1), F.col("sd") > 0, F.col("positive") == 1, F.col("positive") > 1)
    return e.select("effect", seeds.alias("seeds"), recovery.alias("recovery"), delta.alias("delta"), one.alias("one_class"), second.alias("second_stage"), roi.alias("roi"), cause.alias("cause"))


def _curve(spark: SparkSession, d: str) -> DataFrame:
    """Daily mean and highest value as epochs 1..30; the mean of each day divisible by seven is NaN."""
    e = fx.table(spark, d, "events").groupBy(F.dayofmonth("ts").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("loss"), F.max("value").alias("fitness"))
    return e.select("epoch", F.when(F.col("epoch") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("loss")).alias("loss"), "fitness")


@query
def q28_curve_audit(spark: SparkSession, d: str) -> DataFrame:
    """Completeness, non-finite rows and the best epoch."""
    return metrics.curve_audit(_curve(spark, d), "epoch", ["loss", "fitness"], 30, "fitness")


@query
def q29_first_nonfinite(spark: SparkSession, d: str) -> DataFrame:
    """Three epochs around the first non-finite one."""
    found = metrics.around_first_bad(_curve(spark, d), "epoch", "loss")
    return found.select("epoch", F.isnan("loss").alias("bad"), "fitness", "offset")


@query
def q30_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Every vector's label against the label of the nearest other vector."""
    prints, labels = fx.prints(spark, d), fx.table(spark, d, "embeddings").select("vec_id", "label")
    found = dedup.nearest(prints, prints, "vec_id")
    pairs = found.join(labels.select(F.col("vec_id").alias("left"), F.col("label").alias("truth")), "left").join(labels.select(F.col("vec_id").alias("right"), F.col("label").alias("found")), "right")
    return metrics.classification_report(metrics.confusion(pairs, "truth", "found", list(range(10))))


def _draws(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = fx.table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 10 < 3).alias("is_hard"))
    weighted = rows.withColumn("w", F.when(F.col("is_hard"), 2).otherwise(1))
    draws = sampling.weighted_draws(weighted, "doc_id", "w", 2048, "seed42")
    return rows, draws.join(rows, "doc_id")


@query
def q31_sampler_audit(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 32 weighted draws."""
    return sampling.batch_audit(_draws(spark, d)[1], "draw", "doc_id", "is_hard")


@query
def q31_draw_summary(spark: SparkSession, d: str) -> DataFrame:
    """Hard draws against what the weights promise."""
    rows, draws = _draws(spark, d)
    return sampling.draw_summary(rows, draws, "is_hard", 2).withColumn("expected", F.round("expected", 9))


@query
def q32_registry_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Orders, every third replaced, and new ones added."""
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    old = o.where(F.col("o_orderkey") % 5 != 0)
    new = o.where((F.col("o_orderkey") % 3 == 0) | (F.col("o_orderkey") % 5 == 0)).withColumn("o_orderstatus", F.lit("N"))
    return joins.upsert(old, new, ["o_orderkey"])


@query
def q33_language_audit(spark: SparkSession, d: str) -> DataFrame:
    """Language of the documents, their kind by a made-up path, and what to do with them."""
    paths = F.array(*map(F.lit, ("docs/exp01_run.md", "docs/handoffs/a.md", "README.md", "docs/final_report.md", "docs/other.md", "notes/x.md")))
    docs = fx.table(spark, d, "documents").select("doc_id", "text", F.element_at(paths, (F.col("doc_id") % 6 + 1).cast("int")).alias("path"))
    return profile.language_audit(docs, "text", "path").drop("text")


@query
def q34_field_profile(spark: SparkSession, d: str) -> DataFrame:
    """Keys of a JSON column with their kinds."""
    return profile.field_profile(fx.table(spark, d, "events"), "props")


@query
def q35_config_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two key-value sets from line items."""
    base = fx.table(spark, d, "lineitem").groupBy(F.concat(F.lit("part"), (F.col("l_partkey") % 50).cast("string")).alias("name")).agg(F.count("*").alias("a"), F.count_if(F.col("l_linenumber") != 7).alias("b"), (F.min("l_partkey") % 50).alias("k"))
    one = base.where(F.col("k") % 9 != 0).select("name", F.col("a").cast("string").alias("value"))
    two = base.where(F.col("k") % 8 != 0).select("name", F.when(F.col("k") % 2 == 0, F.col("a")).otherwise(F.col("b")).cast("string").alias("value"))
    return joins.config_diff(one, two, ["part1", "part3"])


@query
def q36_leakage_gate(spark: SparkSession, d: str) -> DataFrame:
    """Leak counts of a split by id against one by group."""
    rows = _split_rows(spark, d).withColumn("by_id", split.hashed_split(F.col("doc_id").cast("string")))
    checks = {"sha_by_id": split.leaks(rows, "sha", "by_id"), "sha_by_group": split.leaks(rows, "sha", "split"), "group_by_group": split.leaks(rows, "group", "split")}
    return gates.expectations(checks)


@query
def q37_artifact_manifest(spark: SparkSession, d: str) -> DataFrame:
    """K5: required pages, whether they are there, not empty and begin as HTML."""
    pages = fx.table(spark, d, "pages")
    required = pages.select((F.col("page_id") * 2).alias("page_id"))
    return gates.artifact_manifest(required, pages, "page_id", "html", "<!DOCTYPE html>")


@query
def q38_case_quota(spark: SparkSession, d: str) -> DataFrame:
    """At most 64 images, eight a category in the fixed order, filled up in scan order (no SQL; tested against the plain loop)."""
    images = fx.truth(spark, d).select("image").distinct().withColumn("scan", F.col("image"))
    chosen = sampling.case_selection(materialise(_categories(spark, d), "categories"), images, "image", "scan")
    return spark.createDataFrame([(i, x) for i, x in enumerate(chosen)], "place int, image long")


@query
def q38_overlay_sample(spark: SparkSession, d: str) -> DataFrame:
    """A check sample of 20, 15 and 15 images by split that covers every class (no SQL; tested against the plain loop)."""
    g = fx.truth(spark, d).withColumns({"name": F.concat(F.lit("class"), F.col("cls").cast("string")), "split": fx.split_of()})
    rows = g.groupBy("image", "split").agg(F.collect_set("name").alias("labels"), F.count("*").alias("instances"))
    rows = rows.withColumn("score", 4 * F.array_contains("labels", "class2").cast("int") + 2 * (F.size("labels") > 1).cast("int") + F.col("instances"))
    chosen = sampling.overlay_sample(rows, "split", "image", "labels", ["class0", "class1", "class2"], "score", {"train": 20, "val": 15, "test": 15})
    return spark.createDataFrame([(i, x) for i, x in enumerate(chosen)], "place int, image long")


@query
def q39_negative_sampling(spark: SparkSession, d: str) -> DataFrame:
    """Confident predictions that hit nothing, in each split half as many as its ground truth at most."""
    g, p, c = _boxes(spark, d)
    found = sampling.hard_negatives(p.where(F.col("conf") >= 0.1).withColumn("split", fx.split_of()), c, g.withColumn("split", fx.split_of()))
    return found.select("split", "image", "pred", "conf", F.round("best", 9).alias("best"))


@query
def q39_background_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Two free boxes an image, with sizes of train's boxes."""
    g = fx.truth(spark, d)
    images = g.select("image").distinct().withColumns({"width": F.lit(640), "height": F.lit(160)})
    sizes = sampling.box_sizes(g.where(fx.split_of() == "train"))
    return sampling.background_boxes(images, g, sizes, 2, attempts=20).select("image", "place", "x1", "y1", "x2", "y2")


@query
def q40_state_tree(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as named tensors."""
    suffix = F.element_at(F.array(*map(F.lit, ("conv.weight", "bn.bias", "bn.running_mean", "bn.num_batches_tracked", "gamma", "bn.running_var", "bn.weight", "head.weight"))), (F.col("vec_id") % 8 + 1).cast("int"))
    values = F.transform("embedding", lambda x: F.when((F.col("vec_id") % 7 == 0) & (x > 0.25), F.lit(float("nan"))).otherwise(x.cast("double")))
    t = fx.table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("layer."), F.col("vec_id").cast("string"), F.lit("."), suffix).alias("name"), values.alias("v"))
    out = metrics.tensor_stats(t, "v").withColumn("category", tensor_category(F.col("name")))
    return out.select("vec_id", "name", "category", "finite_ratio", "lowest", "highest", "mean", "n_nan", "n_inf")


@query
def q41_split_search(spark: SparkSession, d: str) -> DataFrame:
    """A searched split of the document groups (no SQL; invariants are tested)."""
    rows = _split_rows(spark, d).select("group", "labels")
    return split.search_split(rows, "group", "labels", {"train": 0.7, "val": 0.15, "test": 0.15}, restarts=6, steps=300)


@query
def q42_label_lines(spark: SparkSession, d: str) -> DataFrame:
    """Label lines of the polygons in unit coordinates, read back and checked."""
    from gaugeflow.sources import labels

    p = fx.polygons(spark, d).withColumn("points", geometry.as_points(F.col("quad")))
    lines = labels.write_lines(p.where(F.col("label") != ""), F.substring("label", 6, 1).cast("int"), F.col("points"), F.lit(1000.0), F.lit(1000.0))
    return labels.parse_lines(lines, "line", 3).groupBy("class_id", "problem").agg(F.count("*").alias("lines"), F.sum(F.size("points")).alias("points"))


@query
def q43_two_stage(spark: SparkSession, d: str) -> DataFrame:
    """A second-stage filter in both modes at two thresholds, scored, with what it keeps and corrects."""
    g, p, c, m = _base_match(spark, d)
    scored = p.where(F.col("conf") >= 0.25).withColumn("u", F.col("conf") * 7 % 1)
    probs = F.array(F.round(1 - F.col("u"), 6), *[F.round(F.col("u") * w, 6) for w in (0.5, 0.3, 0.2)])
    scored = scored.withColumn("probs", F.when(F.col("cls") == 1, F.array(probs[0], probs[2], probs[1], probs[3])).otherwise(probs))
    out = None
    for mode in ("A", "B"):
        for t in (0.3, 0.45):
            kept = matching.two_stage(scored, "probs", t, mode)
            kept = kept.withColumn("cls", F.col("cls") - 1) if mode == "B" else kept
            kept = materialise(kept.select("image", "pred", "cls", "conf", *matching.BOX, *matching.MASK), "stage2")
            after = materialise(matching.greedy(matching.candidates(g, kept)), "after")
            row = matching.fixed_point(g, kept, after, []).crossJoin(matching.retained(m, after))
            row = row.select(F.lit(mode).alias("mode"), F.lit(t).alias("threshold"), "tp", "fp", "fn", *[F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")], "eligible", "kept", "corrected", "harmed")
            out = row if out is None else out.unionByName(row)
    return out


@query
def q44_probe_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Batches, non-finite ones and the first value, by day and type."""
    e = fx.table(spark, d, "events").withColumn("loss", F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return metrics.probe_rollup(e.withColumn("day", F.dayofmonth("ts")), ["day", "event_type"], "event_id", "loss")


@query
def q45_integrity(spark: SparkSession, d: str) -> DataFrame:
    """C4: a manifest of digests against what is there now, some rows changed and some gone."""
    o = fx.table(spark, d, "orders")
    digest = F.sha2(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderstatus"), 256)
    now = o.where(F.col("o_orderkey") % 101 != 0).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 103 == 0, "X").otherwise(F.col("o_orderstatus")))
    return joins.integrity(o.select("o_orderkey", digest.alias("sha")), now.select("o_orderkey", digest.alias("sha")), "o_orderkey", "sha").select("o_orderkey", F.col("found").isNull().alias("gone"))


@query
def q46_class_weights(spark: SparkSession, d: str) -> DataFrame:
    """Sampling weights that balance classes."""
    w = sampling.class_weights(fx.table(spark, d, "embeddings").select("vec_id", "label"), "label")
    return w.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("total"))


@query
def q47_pool_tie_rules(spark: SparkSession, d: str) -> DataFrame:
    """How far the two tie rules' pools agree."""
    g, p, c, m = _base_match(spark, d)
    kept = F.col("conf") >= 0.25
    pool = lambda tie: matching.hard_pool(g, g, p.where(kept), c.where(kept), m, tie_break=tie).where("is_hard").select("image")
    return pool("asc").withColumn("a", F.lit(1)).join(pool("desc").withColumn("b", F.lit(1)), "image", "full_outer").agg(F.count("a").alias("rule_b"), F.count("b").alias("rule_a"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))


@query
def q48_table_digest(spark: SparkSession, d: str) -> DataFrame:
    """The digest of a table, whatever its order."""
    return gates.table_digest(fx.table(spark, d, "nation"))


@query
def q49_grouped_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall, mean and median IoU of hits by split and class."""
    g, p, c, m = _base_match(spark, d)
    rows = g.join(m.select("image", "gt", F.col("mask_iou").alias("iou")), ["image", "gt"], "left").withColumn("split", fx.split_of())
    return rows.groupBy("split", "cls").agg(F.count("*").alias("instances"), F.count("iou").alias("hits"), F.round(ratio(F.count("iou"), F.count("*")), 9).alias("recall"), F.round(F.avg("iou"), 6).alias("mean_iou"), F.round(F.median("iou"), 6).alias("median_iou"))


@query
def q50_top_values(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent properties, ties by first occurrence."""
    return profile.top_values(fx.table(spark, d, "events"), "props", "event_id", 20)


@query
def q51_duplicate_context(spark: SparkSession, d: str) -> DataFrame:
    """The context of each document by its group of equal texts and their label sets, with errors by context; toxic stands for an error."""
    rows = _split_rows(spark, d).withColumn("near", F.when(F.col("group").startswith("group_"), F.col("group"))).withColumn("label_set", F.array_join("labels", "|"))
    audited = matching.duplicate_context(rows, "near", "label_set").withColumn("category", F.when(F.array_contains("labels", "toxic1"), "wrong_class").when(F.array_contains("labels", "quality0"), "low_box_iou").otherwise("TP"))
    return matching.errors_by_context(audited).withColumn("error_rate", F.round("error_rate", 9))


@query
def q52_value_profile(spark: SparkSession, d: str) -> DataFrame:
    """Kinds, lengths and the 50 most frequent values of one field of a JSON column."""
    return profile.value_profile(fx.table(spark, d, "events"), "props", "k")


@query
def q52_version_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per order status (as version) its orders, priorities (as labels), suffixes of made-up paths and numeric stems."""
    o = fx.table(spark, d, "orders")
    stem = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("img_"), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderkey").cast("string"))
    path = F.concat(stem, F.when(F.col("o_orderkey") % 2 == 0, ".JPG").otherwise(".png"))
    docs = o.select(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("version"), F.array("o_orderpriority").alias("labels"), path.alias("path"), stem.alias("stem"))
    return profile.version_profile(docs, "version", "labels", "path", "stem")


@query
def q53_name_counts(spark: SparkSession, d: str) -> DataFrame:
    """All-digit names and the prefixes of numbered ones."""
    k = F.col("o_orderkey")
    stem = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.concat(F.lit("scan-"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("x_y"), (k % 5).cast("string"), F.lit("_"), k.cast("string"))).otherwise("plain")
    return profile.name_counts(fx.table(spark, d, "orders").select(stem.alias("stem")), "stem")


@query
def q54_split_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one split, in the manifest's order, joined with their place by ordinal; an unknown split would stop the query."""
    val = profile.of_split(_split_rows(spark, d).select("doc_id", "split"), "split", "val")
    placed = global_place(val, joins.split_order(list(split.SPLITS), "split", "doc_id"), "ordinal")
    return joins.zipped(placed, placed.select("ordinal", (F.col("ordinal") * 2).alias("twice")), "ordinal")


@query
def q55_pairing(spark: SparkSession, d: str) -> DataFrame:
    """Orders with one or several candidates by name; those pair that are alone in name, or in name and folder."""
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    side = lambda n, m: o.where(F.col("k") % n != 0).select(F.concat(F.lit("S"), (F.col("c") % 400).cast("string")).alias("stem"), F.concat(F.lit("d"), (F.col("k") % m).cast("string")).alias("parent"), F.concat_ws("/", F.lit(str(n)), F.col("k").cast("string")).alias("path"))
    return joins.unique_pairs(side(3, 40), side(4, 40), "stem", "parent", "path")


@query
def q56_source_leak(spark: SparkSession, d: str) -> DataFrame:
    """Sources of documents that are in train and val alike; a leak if they must be apart."""
    rows = _split_rows(spark, d).join(fx.table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return joins.shared_keys(rows.where("split = 'train'"), rows.where("split = 'val'"), "source")


@query
def q57_unknown_labels(spark: SparkSession, d: str) -> DataFrame:
    """F1, B2: labels that the known classes lack, with how often they are there at all."""
    known = spark.createDataFrame([("class0",), ("class1",)], "label string")
    p = fx.polygons(spark, d).select(F.when(F.col("label") != "", F.col("label")).alias("label"))
    return p.groupBy("label", profile.presence(F.col("label")).alias("presence")).agg(F.count("*").alias("n")).join(known, "label", "left_anti")


@query
def q58_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Area of an image's polygons over its own."""
    return report.coverage(_measured(spark, d), "image", "area", "width", "height").withColumn("coverage", F.round("coverage", 9))


@query
def q58_label_counts(spark: SparkSession, d: str) -> DataFrame:
    """Images of one label and of several, and the imbalance of classes."""
    return report.label_counts(fx.truth(spark, d), "image", "cls").withColumn("imbalance", F.round("imbalance", 9))


@query
def q59_one_class(spark: SparkSession, d: str) -> DataFrame:
    """Images with the shapes of one class; others stay as background."""
    g = fx.truth(spark, d)
    return report.one_class(g.select("image").distinct(), g, "image", "cls", 1)


@query
def q60_latency(spark: SparkSession, d: str) -> DataFrame:
    """First stage an order, second stage a line item, joined by order."""
    images = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("image"), (F.col("o_totalprice") / 1000).alias("ms"))
    found = report.latency(images, fx.table(spark, d, "lineitem").where("l_linenumber > 2").select(F.col("l_orderkey").alias("image"), F.col("l_quantity").cast("double").alias("ms")), "image", "ms")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query
def q61_mask_iou(spark: SparkSession, d: str) -> DataFrame:
    """Polygons of parts rasterised on a 64 x 48 grid, against a shifted copy; rectangles, so SQL can count pixels."""
    p = fx.table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    x1, y1, x2, y2 = F.col("k") % 20, F.col("k") % 15, 25 + F.col("k") % 38, 18 + F.col("k") % 29
    unit = lambda dx, dy: (F.array(*[(a + dx) / F.lit(63.0) for a in (x1, x2, x2, x1)]), F.array(*[(b + dy) / F.lit(47.0) for b in (y1, y1, y2, y2)]))
    mask = lambda dx, dy: geometry.polygon_mask(*unit(dx, dy), F.lit(64), F.lit(48))
    m = p.select("k", mask(0, 0).alias("a"), mask(1, F.col("k") % 2).alias("b"))
    return m.select("k", F.round(geometry.mask_iou("a", "b"), 9).alias("iou"))


@query
def q62_padded_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes padded by a fifth and clipped to the image."""
    box = padded_box(*[F.col(c) for c in matching.BOX], F.lit(500), F.lit(140))
    return fx.truth(spark, d).select("image", "gt", box.alias("b")).select("image", "gt", "b.*")


@query
def q63_tensor_diff(spark: SparkSession, d: str) -> DataFrame:
    """Vectors against changed ones by name, and the inexact ones counted by label."""
    e = fx.table(spark, d, "embeddings")
    a = e.where("vec_id % 11 <> 0").select(F.col("vec_id").cast("string").alias("name"), "embedding")
    b = e.where("vec_id % 13 <> 0").select(F.col("vec_id").cast("string").alias("name"), F.when(F.col("vec_id") % 3 == 0, F.transform("embedding", lambda x: x + F.lit(0.25).cast("float"))).when(F.col("vec_id") % 17 == 0, F.slice("embedding", 1, 5)).otherwise(F.col("embedding")).alias("embedding"))
    found = metrics.tensor_diff(a, b, "name", "embedding").join(e.select(F.col("vec_id").cast("string").alias("name"), "label"), "name")
    return metrics.mismatch_counts(found.withColumn("exact", F.col("status") == "exact"), "exact", "status", "label")


@query
def q63_state_tree(spark: SparkSession, d: str) -> DataFrame:
    """JSON trees flattened to paths and values."""
    e = fx.table(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("a"), F.array(F.struct(F.col("user_id").alias("u")), F.struct((F.col("event_id") % 7).alias("u"))).alias("b"))).alias("tree"))
    return metrics.flattened(e, "event_id", "tree")


@query
def q64_metrics_long(spark: SparkSession, d: str) -> DataFrame:
    """H5: nested metric records as columns, then as rows."""
    n = fx.table(spark, d, "nation").select("n_nationkey", F.struct((F.col("n_nationkey") / 25.0).alias("P"), (F.col("n_regionkey") / 5.0).alias("R")).alias("Box"), F.struct((F.col("n_nationkey") / 50.0).alias("P"), (F.col("n_regionkey") / 10.0).alias("R")).alias("Mask"))
    return report.long_metrics(report.flat_metrics(n, ["n_nationkey"], ["Box", "Mask"], ["P", "R"]), ["n_nationkey"]).withColumn("value", F.round("value", 9))


@query
def q65_counters(spark: SparkSession, d: str) -> DataFrame:
    """Labels of an image as JSON counters, read back; its boxes as a JSON array and back."""
    g = fx.truth(spark, d).withColumn("name", F.concat(F.lit("class"), F.col("cls").cast("string")))
    encoded = report.counter_json(g, "image", "name")
    boxes = g.select("image", F.get(report.json_array(report.array_json(F.array(*[F.col(c).cast("double") for c in matching.BOX]))), F.lit(2)).alias("x2")).groupBy("image").agg(F.max("x2").alias("right"))
    return report.counter_rows(encoded, "image").join(encoded, "image").join(boxes, "image")


@query
def q66_freeze_checks(spark: SparkSession, d: str) -> DataFrame:
    """K3: the checks before a split of documents is frozen, on a manifest split by id and label lines with faults."""
    rows = _split_rows(spark, d).withColumn("by_id", split.hashed_split(F.col("doc_id").cast("string")))
    manifest = rows.select(F.col("doc_id").alias("stem"), F.col("by_id").alias("split"), F.col("sha").alias("sha256"), F.col("group").alias("group_id"))
    lines = manifest.where("stem % 97 <> 0").select("stem", "split", (F.col("stem") % 3).cast("int").alias("class_id"), F.when(F.col("stem") % 101 == 1, "no_area").alias("problem"))
    return gates.expectations(gates.freeze_checks(manifest, lines, lines.where("class_id < 2"), [0, 1, 2]))


@query
def q67_training_rows(spark: SparkSession, d: str) -> DataFrame:
    """K4, A10: integrity of label files, one an order; some lines are broken, out of range, of a bad class or without area."""
    t = fx.items(spark, d)
    w = F.col("p") % 40 / 100.0
    xy = [F.col("q") / 100.0, F.col("disc") / 20.0]
    coords = F.concat_ws(" ", (F.col("n") % 3 + F.when(F.col("p") % 53 == 0, 7).otherwise(0)).cast("string"), *[c.cast("string") for c in (xy[0], xy[1], xy[0] + w, xy[1], xy[0] + w, xy[1] + F.when(F.col("s") % 59 == 0, 3.0).otherwise(0.25))])
    line = F.when(F.col("p") % 61 == 0, F.lit("1 0.1 0.2")).otherwise(coords)
    lines = t.select("image", F.col("gi").alias("number"), line.alias("line"))
    i = F.col("image")
    images = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("image")).select(i.alias("dataset_index"), "image", (i % 10 < 3).alias("is_hard"), F.concat(F.lit("/images/"), i.cast("string"), F.lit(".png")).alias("image_path"), (i % 211 != 0).alias("image_decode_ok"), (i % 211 != 0).alias("image_finite"))
    found = report.training_rows(images.withColumn("label_path", files.label_path(F.col("image_path"))), lines, "image", 7)
    return found.withColumn("relative_polygon_area_sum", F.round("relative_polygon_area_sum", 9))


@query
def q67_training_summary(spark: SparkSession, d: str) -> DataFrame:
    """K4: how many images and targets are invalid, in all and among the hard ones."""
    return report.training_summary(q67_training_rows(spark, d))


@query
def q68_gate_chain(spark: SparkSession, d: str) -> DataFrame:
    """A chain of equalities, the third of which fails, and whether budgets are equal."""
    o = fx.table(spark, d, "orders")
    budgets = sampling.budgets_equal(spark.createDataFrame([(10, 5), (10, 6)], "images int, steps int"), ["images", "steps"])
    facts = o.agg((F.count_if(F.col("o_orderkey") < 0)).alias("negative"), (F.count("*") == F.countDistinct("o_orderkey")).alias("unique")).crossJoin(budgets)
    return gates.gate_chain(facts, [("no_negative_key", "negative", 0), ("unique_keys", "unique", "true"), ("equal_steps", "equal_steps", "true"), ("equal_images", "equal_images", "true")])


@query
def q69_reproduction(spark: SparkSession, d: str) -> DataFrame:
    """K7: epochs whose pattern of non-finite values a second run does not reproduce."""
    one = _curve(spark, d)
    two = one.where("epoch <> 5").withColumn("loss", F.when(F.col("epoch") % 14 == 0, F.lit(1.0)).otherwise(F.col("loss")))
    return gates.reproduction(one, two, "epoch", ["loss", "fitness"]).select("epoch", *[F.array_join(c, "|").alias(c) for c in ("bad_a", "bad_b")])


@query
def q70_conflict_review(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as a group of near duplicates; their label sets, hints and the spread of their centres."""
    g = fx.truth(spark, d).join(fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("image"), F.col("o_custkey").alias("group_id")), "image")
    per = g.groupBy("group_id", "image", F.concat(F.lit("class"), F.col("cls").cast("string")).alias("label")).agg(F.count("*").alias("n"))
    counts = per.groupBy("group_id", "image").agg(F.sort_array(F.collect_list(F.struct("label", "n"))).alias("counts"))
    centres = g.groupBy("image").agg(F.avg((F.col("x1") + F.col("x2")) / 1000).alias("x"), F.avg((F.col("y1") + F.col("y2")) / 280).alias("y"))
    members = counts.join(centres, "image").withColumnRenamed("image", "member")
    edges = counts.select("group_id", (F.col("image") % 6).alias("phash_distance"), (F.col("image") % 9).alias("dhash_distance"), (F.lit(0.98) + F.col("image") % 3 / 100).alias("correlation"))
    found = report.conflict_review(members, edges)
    return found.withColumns({c: F.round(c, 6) for c in ("normalized_mean_centroid_spread", "min_correlation", "max_correlation")})


@query
def q71_document_issues(spark: SparkSession, d: str) -> DataFrame:
    """H1, K1: shapes that are no list, entries that are no object, and sizes that differ from the image's."""
    k = F.col("o_orderkey")
    shapes = F.when(k % 5 == 0, F.lit('{"a":1}')).when(k % 5 == 1, F.lit('[{"label":"x"},3,"s",{"label":"y"}]')).when(k % 5 == 2, F.lit("null")).otherwise("[]")
    raw = F.concat(F.lit('{"shapes":'), shapes, F.lit(',"imageWidth":'), (k % 4 * 10).cast("string"), F.lit(',"imageHeight":10}'))
    o = fx.table(spark, d, "orders")
    images = o.where("o_orderkey % 3 <> 0").select(k.cast("string").alias("path"), F.lit(20).alias("width"), F.lit(10).alias("height"))
    return files.document_issues(o.select(k.cast("string").alias("path"), raw.alias("raw")), images).groupBy("issue", "shape_index").agg(F.count("*").alias("n"))


@query
def q72_paths(spark: SparkSession, d: str) -> DataFrame:
    """What page addresses are as paths, their stems and suffixes, and their kind by the first pattern that fits."""
    p = fx.table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/data/images/IMG"), F.col("page_id").cast("string"), F.lit(".JPG"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("docs/report"), F.col("page_id").cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("C:\\x\\"), F.col("page_id").cast("string"))).alias("path"))
    kind = report.document_kind(F.lower("path"), [(r"^docs/", "document"), (r"[.]jpg$", "image")])
    return p.select("page_id", files.absolute(F.col("path")).alias("absolute"), files.stem(F.col("path")).alias("stem"), files.suffix(F.col("path")).alias("suffix"), files.label_path(F.col("path")).alias("label_path"), kind.alias("kind"))


@query
def q73_records(spark: SparkSession, d: str) -> DataFrame:
    """The last record of a log, the digest of an array, and a record with numbers that JSON lacks."""
    lines = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("line"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('step RESULT={"k":'), F.col("o_orderkey").cast("string"), F.lit("}"))).otherwise("noise").alias("value"))
    last = joins.latest_line(lines, "RESULT", "k long")
    digest = report.array_digest(F.lit("float32"), F.array(F.lit(2), F.lit(3)), F.lit("abc").cast("binary"))
    return last.select("k", digest.alias("digest"), report.safe_json(F.struct(F.col("k"), F.lit(float("nan")).alias("v"), F.lit(float("-inf")).alias("w")), ["v", "w"]).alias("record"))


@query
def q74_number_violations(spark: SparkSession, d: str) -> DataFrame:
    """Cells that hold something else than a number, with their column."""
    o = fx.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 17 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("a"), F.when(F.col("o_orderkey") % 19 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("b"))
    return files.cast_violations(o, ["a", "b"]).select("o_orderkey", "column", "value")
