"""Matching of ground truth with predictions, error taxonomies, threshold sweeps and hard pools.

Ground truth: image, gt, cls, x1, y1, x2, y2. Predictions: image, pred, cls, conf, x1, y1, x2, y2. Either both or none
have masks: mx1, my1, mx2, my2 bound the mask and, unless it fills them, ``runs`` holds it as row-major run lengths. Without masks
the box stands for the mask. Matches go by mask IoU; the taxonomies read both IoUs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.exprs import box_iou, f1, ratio, size_bin
from gaugeflow.operators.geometry import mask_iou
from gaugeflow.operators.ranking import global_place
from gaugeflow.session import discard, materialise

BOX = ("x1", "y1", "x2", "y2")
MASK = ("mx1", "my1", "mx2", "my2")


def candidates(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """All (gt, pred) of an image whose boxes or masks' bounds overlap, with mask_iou, box_iou and both classes. Other pairs have IoUs of 0 and are not formed."""
    masked = {*MASK} <= {*truth.columns} and {*MASK} <= {*predictions.columns}
    runs = "runs" in truth.columns and "runs" in predictions.columns
    extra = [*(MASK if masked else ()), *(["runs"] if runs else [])]
    g = truth.select("image", "gt", F.col("cls").alias("gt_cls"), *[F.col(c).alias(f"g_{c}") for c in (*BOX, *extra)])
    p = predictions.select("image", "pred", F.col("cls").alias("pred_cls"), "conf", *[F.col(c).alias(f"p_{c}") for c in (*BOX, *extra)])
    meet = lambda x1, y1, x2, y2: (F.col(f"g_{x1}") < F.col(f"p_{x2}")) & (F.col(f"p_{x1}") < F.col(f"g_{x2}")) & (F.col(f"g_{y1}") < F.col(f"p_{y2}")) & (F.col(f"p_{y1}") < F.col(f"g_{y2}"))
    overlap = meet(*BOX) | meet(*MASK) if masked else meet(*BOX)
    of_mask = mask_iou("g_runs", "p_runs") if runs else box_iou("g_m", "p_m", "") if masked else box_iou("g", "p")
    return g.join(p, "image").where(overlap).select("image", "gt", "pred", "gt_cls", "pred_cls", "conf", of_mask.alias("mask_iou"), box_iou("g", "p").alias("box_iou"))


def greedy(pairs: DataFrame, least: float = 0.5, by_class: bool = True, keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """One-to-one matches in order of (mask_iou, gt, pred) downwards, larger numbers first on ties.

    The order is total, so a pair that is the best of both its sides is a match; such pairs leave with all
    that share a side, and rounds go on until none is left. Same result as the sequential scan,
    without one task a key: a hot image is as many windows as it has boxes.
    """
    left = pairs.where(F.col("mask_iou") >= least)
    if by_class:
        left = left.where(F.col("gt_cls") == F.col("pred_cls"))
    columns = [*keys, "gt", "pred", "gt_cls", "pred_cls", "conf", "mask_iou", "box_iou"]
    left = materialise(left.select(*columns), "pairs")
    order = [F.col("mask_iou").desc(), F.col("gt").desc(), F.col("pred").desc()]
    out = None
    while True:
        ranked = left.withColumn("g", F.row_number().over(Window.partitionBy(*keys, "gt").orderBy(*order))).withColumn("p", F.row_number().over(Window.partitionBy(*keys, "pred").orderBy(*order)))
        won = materialise(ranked.where((F.col("g") == 1) & (F.col("p") == 1)).select(*columns), "matches")
        out = won if out is None else out.unionByName(won)
        rest = left.join(won.select(*keys, "gt"), [*keys, "gt"], "left_anti").join(won.select(*keys, "pred"), [*keys, "pred"], "left_anti")
        before, left = left, materialise(rest.select(*columns), "pairs")
        discard(before)
        if left.isEmpty():
            discard(left)
            return out


def fixed_point(truth: DataFrame, predictions: DataFrame, matches: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 by keys that all three have."""
    g = truth.groupBy(*by).agg(F.count("*").alias("actual"))
    p = predictions.groupBy(*by).agg(F.count("*").alias("predicted"))
    m = matches.groupBy(*by).agg(F.count("*").alias("tp"))
    d = g.join(p, by, "full_outer").join(m, by, "left").na.fill(0, ["actual", "predicted", "tp"]) if by else g.crossJoin(p).crossJoin(m)
    return d.select(*by, *scores(F.col("tp"), F.col("predicted"), F.col("actual")))


def scores(tp: Column, predicted: Column, actual: Column) -> list[Column]:
    return [tp.alias("tp"), (predicted - tp).alias("fp"), (actual - tp).alias("fn"), ratio(tp, predicted).alias("precision"), ratio(tp, actual).alias("recall"), f1(tp, predicted, actual).alias("f1")]


SLICES = 8


def matched_levels(pairs: DataFrame, rows: int = 0, slice_rows: int = 8_000_000) -> DataFrame:
    """(cls, won, n): counts of the matches that ``greedy`` would find by class at every level, in one pass for all levels.

    ``pairs`` has image, gt, pred, cls, mask_iou and ``live``, a number whose bit i says that the pair takes part at level i. A pair wins the levels at which it is the best
    of both its sides, and those levels are over for all that share a side; so each round is ``greedy``'s round at every level, over one row a pair instead of one a pair and level.
    The first round runs where the pairs lie. What is written is what a round decided, and whole pairs only where levels are left.

    A round over many rows (``rows`` says of how many the pairs are made) takes the images in up to ``SLICES`` slices, one after the other, so that only a slice is shuffled at a time;
    each slice reads its input anew.
    """
    order = [F.col("mask_iou").desc(), F.col("gt").desc(), F.col("pred").desc()]
    before = lambda side: F.coalesce(F.bit_or("live").over(Window.partitionBy("image", side).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    over = lambda side: F.bit_or("won").over(Window.partitionBy("image", side))
    # not the hash by which Spark deals rows to partitions, of which a slice would fill only some
    part = F.xxhash64("image")
    done, left = [], pairs
    while True:
        slices = min(SLICES, 1 + rows // slice_rows)
        found = []
        for i in range(slices):
            d = left.where(F.pmod(part, F.lit(slices)) == i) if slices > 1 else left
            d = d.withColumn("by_gt", before("gt")).withColumn("by_pred", before("pred"))
            d = d.withColumn("won", F.col("live").bitwiseAND(F.bitwise_not(F.col("by_gt").bitwiseOR(F.col("by_pred")))))
            d = d.withColumn("over_pred", over("pred")).withColumn("over_gt", over("gt"))
            d = d.withColumn("live", F.col("live").bitwiseAND(F.bitwise_not(F.col("over_gt").bitwiseOR(F.col("over_pred"))))).where((F.col("won") != 0) | (F.col("live") != 0))
            d = d.select("cls", "won", "live", *[F.when(F.col("live") != 0, F.col(c)).alias(c) for c in ("image", "gt", "pred", "mask_iou")])
            found.append(materialise(d, "levels", wide=True, release=True))
        done += found
        left = reduce(DataFrame.unionByName, found).where(F.col("live") != 0).drop("won")
        rows = left.count()
        if not rows:
            break
    won = reduce(DataFrame.unionByName, [d.select("cls", "won") for d in done])
    out = materialise(won.where(F.col("won") != 0).groupBy("cls", "won").agg(F.count("*").alias("n")), "sweep")
    discard(*done)
    return out


LEVELS = 62


def sweep(truth: DataFrame, predictions: DataFrame, thresholds: list[float], least: float = 0.5, slice_rows: int = 8_000_000) -> DataFrame:
    """Scores and per-class recall (rows of threshold and cls; cls -1 is all) at every confidence threshold.

    Pairs are formed once and never multiplied by the thresholds: a number's bits say at which of them a pair takes part. More than ``LEVELS`` thresholds go in several such passes.
    Truth and predictions of more than ``slice_rows`` rows together are matched in slices of images, see ``matched_levels``.
    """
    if len(thresholds) > LEVELS:
        return sweep(truth, predictions, thresholds[:LEVELS], least, slice_rows).unionByName(sweep(truth, predictions, thresholds[LEVELS:], least, slice_rows))
    t = truth.sparkSession.createDataFrame(list(enumerate(thresholds)), "level int, threshold double")
    zero = F.lit(0).cast("long")
    live = sum((F.when(F.col("conf") >= x, F.lit(1 << i).cast("long")).otherwise(zero) for i, x in enumerate(thresholds)), zero)
    # classes compared so that they do not become keys of the join: boxes that lie by images stay where they are
    same = F.col("gt_cls").isNotNull() & F.col("pred_cls").isNotNull() & (F.least("gt_cls", "pred_cls") == F.greatest("gt_cls", "pred_cls"))
    pairs = candidates(truth, predictions).where((F.col("mask_iou") >= least) & same)
    pairs = pairs.select("image", "gt", "pred", F.col("gt_cls").alias("cls"), "mask_iou", live.alias("live")).where(F.col("live") != 0)
    # counts by class and bits first: a row of the tables is not multiplied either
    levels = lambda d: d.select("n", "bits", F.explode(F.array(F.lit(-1), F.col("cls").cast("int"))).alias("cls")).crossJoin(F.broadcast(t)).where(F.expr("shiftright(bits, level) & 1") == 1)
    at = lambda d, name: levels(d).groupBy("threshold", "cls").agg(F.sum("n").alias(name))
    counted = lambda d, bits: d.select("cls", bits.alias("bits")).groupBy("cls", "bits").agg(F.count("*").alias("n"))
    g = at(counted(truth, F.lit((1 << len(thresholds)) - 1).cast("long")), "actual")
    p = at(counted(predictions, live), "predicted")
    m = at(matched_levels(pairs, truth.count() + predictions.count(), slice_rows).withColumnRenamed("won", "bits"), "tp")
    d = g.join(p, ["threshold", "cls"], "left").join(m, ["threshold", "cls"], "left").na.fill(0, ["predicted", "tp"])
    return d.select("threshold", "cls", *scores(F.col("tp"), F.col("predicted"), F.col("actual")))


def sweep_choice(swept: DataFrame) -> DataFrame:
    """The threshold of best F1 (the largest within 1e-12) and the largest that keeps 95 % of the highest recall."""
    d = swept.where(F.col("cls") == -1)
    top = d.agg(F.max("f1").alias("f"), F.max("recall").alias("r"))
    return d.crossJoin(F.broadcast(top)).agg(F.max(F.when(F.col("f1") >= F.col("f") - 1e-12, F.col("threshold"))).alias("best_f1_threshold"), F.max("f").alias("best_f1"), F.max(F.when(F.col("recall") >= 0.95 * F.col("r"), F.col("threshold"))).alias("recall95_threshold"))


def nearest_of_class(missed: DataFrame, predictions: DataFrame, pairs: DataFrame, *others: Column) -> DataFrame:
    """``missed`` (image, gt, cls) with ``near``, its prediction of the same class of highest mask IoU (ties to the smaller number), null if the image has none.

    Predictions that overlap nothing count too: (image, class) finds their first without forming pairs. ``others`` are aggregates of the gt's pairs.
    """
    first = predictions.groupBy("image", "cls").agg(F.min(F.struct("pred", "conf")).alias("first"))
    m = missed.join(first, ["image", "cls"], "left").select("image", "gt", "cls", "first")
    same = F.col("gt_cls") == F.col("pred_cls")
    touching = F.max(F.when(same & (F.col("mask_iou") > 0), F.struct("mask_iou", (-F.col("pred")).alias("order"), "pred", "conf", "box_iou")))
    # without any common pixel the first prediction stands; its box may overlap all the same
    its_box = F.max(F.when(same & (F.col("pred") == F.col("first.pred")), F.col("box_iou")))
    d = m.join(pairs, ["image", "gt"], "left").groupBy("image", "gt").agg(F.first("cls").alias("cls"), F.first("first").alias("first"), touching.alias("touching"), its_box.alias("its_box"), *others)
    best = F.struct(F.col("touching.pred").alias("pred"), F.col("touching.conf").alias("conf"), F.col("touching.mask_iou").alias("mask_iou"), F.col("touching.box_iou").alias("box_iou"))
    only = F.struct(F.col("first.pred").alias("pred"), F.col("first.conf").alias("conf"), F.lit(0.0).alias("mask_iou"), F.coalesce("its_box", F.lit(0.0)).alias("box_iou"))
    near = F.when(F.col("touching").isNotNull(), best).when(F.col("first").isNotNull(), only)
    return d.withColumn("near", near).drop("first", "touching", "its_box")


def fn_taxonomy(truth: DataFrame, predictions: DataFrame, pairs: DataFrame, matched: DataFrame, base_conf: float = 0.25, least: float = 0.5) -> DataFrame:
    """Of each unmatched gt the category, by the first rule that fits, and the prediction that says so.

    LOW_CONF_RECOVERABLE: one of its class under ``base_conf`` reaches the mask IoU. WRONG_CLASS: one of another class reaches mask or box IoU.
    LOCALIZATION_FAILURE: the image has any prediction of its class, wherever. NO_RESPONSE: it has none.
    """
    missed = truth.join(matched.select("image", "gt"), ["image", "gt"], "left_anti").select("image", "gt", "cls")
    same = F.col("gt_cls") == F.col("pred_cls")
    either = F.greatest("mask_iou", "box_iou")
    picked = lambda rank: F.struct(rank.alias("rank"), (-F.col("pred")).alias("order"), "pred", "conf", "mask_iou", "box_iou")
    low = F.max(F.when(same & (F.col("mask_iou") >= least) & (F.col("conf") < base_conf), picked(F.col("mask_iou"))))
    wrong = F.max(F.when(~same & (either >= least), picked(either)))
    d = nearest_of_class(missed, predictions, pairs, low.alias("low"), wrong.alias("wrong"))
    kind = F.when(F.col("low").isNotNull(), "LOW_CONF_RECOVERABLE").when(F.col("wrong").isNotNull(), "WRONG_CLASS").when(F.col("near").isNotNull(), "LOCALIZATION_FAILURE").otherwise("NO_RESPONSE")
    chosen = {c: F.coalesce(F.col(f"low.{c}"), F.col(f"wrong.{c}"), F.col(f"near.{c}")) for c in ("pred", "conf", "mask_iou", "box_iou")}
    return d.select("image", "gt", "cls", kind.alias("category"), *[v.alias(k) for k, v in chosen.items()])


def test_taxonomy(truth: DataFrame, predictions: DataFrame, pairs: DataFrame, matched: DataFrame, boundary: float = 0.65, least: float = 0.5) -> DataFrame:
    """(image, side, index, cls, category, mask_iou): every gt as TP, POOR_MASK_BOUNDARY (matched under ``boundary``), WRONG_CLASS, LOCALIZATION_FAILURE or NO_RESPONSE; every unmatched prediction as FP."""
    kinds = fn_taxonomy(truth, predictions, pairs, matched, base_conf=-1.0, least=least).select("image", "gt", "cls", "category", "mask_iou")
    hit = matched.select("image", "gt", F.col("gt_cls").alias("cls"), F.when(F.col("mask_iou") < boundary, "POOR_MASK_BOUNDARY").otherwise("TP").alias("category"), "mask_iou")
    fp = predictions.join(matched.select("image", "pred"), ["image", "pred"], "left_anti").select("image", "pred", "cls", F.lit("FP").alias("category"), F.lit(None).cast("double").alias("mask_iou"))
    side = lambda d, name, key: d.select("image", F.lit(name).alias("side"), F.col(key).alias("index"), "cls", "category", "mask_iou")
    return side(kinds, "gt", "gt").unionByName(side(hit, "gt", "gt")).unionByName(side(fp, "pred", "pred"))


def image_categories(taxonomy: DataFrame, truth: DataFrame, bins: DataFrame) -> DataFrame:
    """(image, category), distinct: the categories of ``test_taxonomy``, TP for a poorly bounded match too, TINY_SMALL_MISS where a gt of the bins tiny or small was missed, MULTI_DEFECT_SCENE for several gt.

    ``bins`` has image, gt and bin.
    """
    missed = taxonomy.where((F.col("side") == "gt") & F.col("category").isin("WRONG_CLASS", "LOCALIZATION_FAILURE", "NO_RESPONSE")).select("image", F.col("index").alias("gt"))
    small = bins.where(F.col("bin").isin("tiny", "small")).join(missed, ["image", "gt"], "left_semi").select("image", F.lit("TINY_SMALL_MISS").alias("category"))
    several = truth.groupBy("image").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("image", F.lit("MULTI_DEFECT_SCENE").alias("category"))
    well = taxonomy.where(F.col("category") == "POOR_MASK_BOUNDARY").select("image", F.lit("TP").alias("category"))
    return taxonomy.select("image", "category").unionByName(well).unionByName(small).unionByName(several).distinct()


def binned(areas: DataFrame, split: str = "split", area: str = "area") -> DataFrame:
    """``areas`` with ``bin``, by the quartiles of the split train alone. The quartiles are one row."""
    q = areas.where(F.col(split) == "train").agg(F.percentile(area, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("__q"))
    return areas.crossJoin(F.broadcast(q)).withColumn("bin", size_bin(F.col(area), F.col("__q")[0], F.col("__q")[1], F.col("__q")[2])).drop("__q")


def duplicate_context(rows: DataFrame, group: str, labels: str) -> DataFrame:
    """``rows`` with duplicate_context: singleton without a group, near_same_label if its group has one label set, near_cross_label if several. Label sets are counted over all rows given."""
    sets = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.countDistinct(labels).alias("__sets"))
    kind = F.when(F.col(group).isNull(), "singleton").when(F.col("__sets") > 1, "near_cross_label").otherwise("near_same_label")
    return rows.join(sets, group, "left").withColumn("duplicate_context", kind).select(*rows.columns, "duplicate_context")


def errors_by_context(audited: DataFrame, context: str = "duplicate_context", error: str = "category") -> DataFrame:
    """Instances, errors, wrong classes and error rate of each of the three contexts, empty ones included."""
    grid = audited.sparkSession.createDataFrame([("singleton",), ("near_same_label",), ("near_cross_label",)], f"{context} string")
    per = audited.groupBy(context).agg(F.count("*").alias("gt_instances"), F.count_if(F.col(error) != "TP").alias("errors"), F.count_if(F.col(error) == "wrong_class").alias("wrong_class"))
    return grid.join(per, context, "left").na.fill(0, ["gt_instances", "errors", "wrong_class"]).withColumn("error_rate", ratio(F.col("errors"), F.col("gt_instances")))


def hard_pool(images: DataFrame, truth: DataFrame, predictions: DataFrame, pairs: DataFrame, matched: DataFrame, share: float = 0.3, tie_break: str = "asc", least: float = 0.5) -> DataFrame:
    """Per image: counts of misses by kind and of false alarms, the hard score, its rank and whether it is in the top share.

    Ties at equal scores go by the image's name as text, ``tie_break`` asc (the one rule) or desc (an older pool's).
    """
    kinds = fn_taxonomy(truth, predictions, pairs, matched, base_conf=-1.0, least=least)
    per = kinds.groupBy("image").agg(F.count_if(F.col("category") == "WRONG_CLASS").alias("wrong"), F.count_if(F.col("category") == "LOCALIZATION_FAILURE").alias("loc"), F.count_if(F.col("category") == "NO_RESPONSE").alias("fn"))
    fp = predictions.join(matched.select("image", "pred"), ["image", "pred"], "left_anti").groupBy("image").agg(F.count("*").alias("fp"))
    d = images.select("image").distinct().join(per, "image", "left").join(fp, "image", "left").na.fill(0, ["wrong", "loc", "fn", "fp"])
    d = d.withColumn("score", 3 * F.col("fn") + 2 * F.col("wrong") + 2 * F.col("loc") + F.col("fp")).withColumn("stem", F.col("image").cast("string"))
    ranked = global_place(d, [F.col("score").desc(), F.col("stem").asc() if tie_break == "asc" else F.col("stem").desc()])
    n = ranked.agg(F.ceil(F.lit(share) * F.count("*")).alias("n"))
    return ranked.crossJoin(F.broadcast(n)).select("image", "fn", "wrong", "loc", "fp", "score", (F.col("place") + 1).alias("rank"), (F.col("place") < F.col("n")).alias("is_hard"))


def agnostic_taxonomy(truth: DataFrame, predictions: DataFrame, pairs: DataFrame, matched: DataFrame, least: float = 0.5) -> DataFrame:
    """(image, side, index, cls, category) of class-blind matches.

    A matched gt is TP or wrong_class. An unmatched one is judged by its nearest prediction of the same class: low_mask_iou if the boxes reach the IoU,
    low_box_iou if not, FN_no_same_class_candidate if the image has none. Predictions: TP, wrong_class_FP or FP_unmatched.
    """
    same = F.col("gt_cls") == F.col("pred_cls")
    missed = truth.join(matched.select("image", "gt"), ["image", "gt"], "left_anti")
    lost = nearest_of_class(missed, predictions, pairs)
    lost = lost.withColumn("category", F.when(F.col("near").isNull(), "FN_no_same_class_candidate").when(F.col("near.box_iou") >= least, "low_mask_iou").otherwise("low_box_iou"))
    hit = matched.select("image", "gt", F.col("gt_cls").alias("cls"), F.when(same, "TP").otherwise("wrong_class").alias("category"))
    p = predictions.join(matched.select("image", "pred", same.alias("same_class")), ["image", "pred"], "left")
    p = p.withColumn("category", F.when(F.col("same_class"), "TP").when(~F.col("same_class"), "wrong_class_FP").otherwise("FP_unmatched"))
    side = lambda d, name, key: d.select("image", F.lit(name).alias("side"), F.col(key).alias("index"), "cls", "category")
    return side(lost, "gt", "gt").unionByName(side(hit, "gt", "gt")).unionByName(side(p, "pred", "pred"))


def two_stage(predictions: DataFrame, probabilities: str, threshold: float, mode: str, background: int = 0) -> DataFrame:
    """Second-stage filter on an array of class probabilities. Mode A keeps what is foreground enough; mode B drops background or doubt, and relabels by the likeliest class."""
    p = F.col(probabilities)
    if mode == "A":
        return predictions.where(1 - F.get(p, F.lit(background)) >= threshold)
    top = (F.array_position(p, F.array_max(p)) - 1).cast("int")
    return predictions.withColumn("cls", top).where((F.col("cls") != background) & (F.array_max(p) >= threshold))


def retained(before: DataFrame, after: DataFrame) -> DataFrame:
    """Matches (image, gt, pred_cls, gt_cls) before and after a filter: kept, corrected, harmed and gained, in counts."""
    ok = lambda d, n: d.select("image", "gt", (F.col("gt_cls") == F.col("pred_cls")).alias(n))
    d = ok(before, "was").join(ok(after, "now"), ["image", "gt"], "full_outer")
    was, now = F.coalesce("was", F.lit(False)), F.coalesce("now", F.lit(False))
    return d.agg(F.count_if(F.col("was").isNotNull()).alias("eligible"), F.count_if(was & now).alias("kept"), F.count_if(~was & now).alias("corrected"), F.count_if(was & ~now).alias("harmed"))
