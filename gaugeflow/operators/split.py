"""Groups, splits without leakage, their profile and objective, and the search for a good one."""

from __future__ import annotations

import random
from array import array
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.exprs import ratio
from gaugeflow.operators.ranking import global_place

SPLITS = ("train", "val", "test")


def group_of(component: Column, member: Column, prefix: str = "group_") -> Column:
    """The component of duplicates (near or exact edges alike), or the member alone."""
    return F.coalesce(F.concat(F.lit(prefix), component.cast("string")), F.concat(F.lit("singleton_"), member.cast("string")))


def hashed_split(group: Column, train: int = 70, val: int = 15) -> Column:
    """A split by the hash of the group, in per cent; the MD5's head, so other engines agree."""
    n = F.conv(F.substring(F.md5(group.cast("binary")), 1, 8), 16, 10).cast("long") % 100
    return F.when(n < train, "train").when(n < train + val, "val").otherwise("test")


def profile(rows: DataFrame, split: str, image: str, labels: str) -> DataFrame:
    """Images and instances of each split (class null) and of each class in it; ``labels`` is an array column with one entry an instance."""
    d = rows.select(F.col(split).alias("split"), F.col(image).alias("image"), F.explode_outer(labels).alias("cls"))
    whole = d.groupBy("split").agg(F.lit(None).cast("string").alias("cls"), F.countDistinct("image").alias("images"), F.count("cls").alias("instances"))
    per = d.where(F.col("cls").isNotNull()).groupBy("split", "cls").agg(F.countDistinct("image").alias("images"), F.count("cls").alias("instances"))
    return whole.unionByName(per.select(*whole.columns))


def leaks(rows: DataFrame, key: str, split: str) -> DataFrame:
    """Keys in more than one split; empty if nothing leaks."""
    return rows.groupBy(key).agg(F.countDistinct(split).alias("splits"), F.count("*").alias("rows")).where(F.col("splits") > 1)


def objective(profiled: DataFrame, ratios: dict[str, float], weight: float = 800, instance_weight: float = 0.35, empty: float = 1000) -> DataFrame:
    """One row, the cost of a split: squared share errors, squared relative class deviations and a charge for each class that a split lacks."""
    spark = profiled.sparkSession
    want = spark.createDataFrame(list(ratios.items()), "split string, share double")
    whole = profiled.where(F.col("cls").isNull())
    total = whole.agg(F.sum("images").alias("all"))
    size = want.join(whole, "split", "left").crossJoin(total).agg((weight * F.sum(F.pow(ratio(F.col("images"), F.col("all")) - F.col("share"), 2))).alias("size_cost"))
    per = profiled.where(F.col("cls").isNotNull())
    sums = per.groupBy("cls").agg(F.sum("images").alias("ai"), F.sum("instances").alias("an"))
    grid = sums.crossJoin(want).join(per.select("split", "cls", "images", "instances"), ["split", "cls"], "left").na.fill(0, ["images", "instances"])
    off = lambda got, all_: F.pow((F.col(got) - F.col(all_) * F.col("share")) / F.greatest(F.lit(3.0), F.col(all_) * F.col("share")), 2)
    cost = grid.agg((F.sum(off("images", "ai")) + instance_weight * F.sum(off("instances", "an"))).alias("class_cost"), (empty * F.count_if(F.col("images") == 0)).cast("double").alias("empty_cost"))
    return size.crossJoin(cost).select(*[F.round(c, 6).alias(c) for c in ("size_cost", "class_cost", "empty_cost")], F.round(F.col("size_cost") + F.col("class_cost") + F.col("empty_cost"), 6).alias("cost"))


Classes = tuple[tuple[str, tuple[int, int]], ...]


def search(groups: Iterable[tuple[str, int, dict[str, tuple[int, int]]]], ratios: dict[str, float], seed: int = 42, restarts: int = 3, steps: int = 2000, temperature: float = 0.02) -> dict[str, str]:
    """A split of groups (name, images, class -> (images, instances)) by greedy starts and annealing; same seed, same result."""
    groups = sorted(groups, key=lambda g: (-g[1], g[0]))
    kinds: dict[tuple[int, Classes], int] = {}
    codes = array("i", (kinds.setdefault((size, tuple(own.items())), len(kinds)) for _, size, own in groups))
    names = list(ratios)
    return {g[0]: names[s] for g, s in zip(groups, search_codes(codes, list(kinds), ratios, seed, restarts, steps, temperature), strict=True)}


def search_codes(codes: Sequence[int], kinds: list[tuple[int, Classes]], ratios: dict[str, float], seed: int = 42, restarts: int = 3, steps: int = 2000, temperature: float = 0.02) -> bytearray:
    """The search over groups in order of size downwards, then name. A group is the number of its kind (images, classes with images and instances); its split comes out as a number too.

    Names play no part, so the search holds five bytes a group. A move costs one group's classes, not all groups': the cost is kept as sums that the move changes.
    """
    rng, names = random.Random(seed), list(ratios)
    shares = [ratios[s] for s in names]
    total = sum(kinds[k][0] for k in codes) or 1
    classes: dict[str, list[int]] = {}
    for k in codes:
        for c, (i, n) in kinds[k][1]:
            have = classes.setdefault(c, [0, 0])
            have[0] += i
            have[1] += n
    wants = [{c: (i * share, n * share) for c, (i, n) in classes.items()} for share in shares]

    def part(s: int, c: str, images: int, instances: int) -> float:
        wi, wn = wants[s][c]
        return ((images - wi) / max(3.0, wi)) ** 2 + 0.35 * ((instances - wn) / max(3.0, wn)) ** 2 + (1000 if not images else 0)

    best: tuple[float, bytearray] = (float("inf"), bytearray(len(codes)))
    for _ in range(restarts):
        images = [0] * len(names)
        got = [{c: (0, 0, part(s, c, 0, 0)) for c in classes} for s in range(len(names))]  # with the cost of that
        cost = sum(800 * share**2 for share in shares) + sum(x[2] for own in got for x in own.values())
        at = bytearray(len(codes))

        def change(kind: tuple[int, Classes], s: int, sign: int, images=images, got=got) -> float:
            size, own = kind
            out = 800 * (((images[s] + sign * size) / total - shares[s]) ** 2 - (images[s] / total - shares[s]) ** 2)
            for c, (i, n) in own:
                oi, on, was = got[s][c]
                out += part(s, c, oi + sign * i, on + sign * n) - was
            return out

        def shift(kind: tuple[int, Classes], s: int, sign: int, images=images, got=got) -> None:
            images[s] += sign * kind[0]
            for c, (i, n) in kind[1]:
                oi, on, _ = got[s][c]
                got[s][c] = (oi + sign * i, on + sign * n, part(s, c, oi + sign * i, on + sign * n))

        for g, k in enumerate(codes):
            kind = kinds[k]
            least, _, s = min([(change(kind, s, 1), rng.random(), s) for s in range(len(names))])
            at[g] = s
            shift(kind, s, 1)
            cost += least
        if cost < best[0]:
            best = cost, bytearray(at)
        for step in range(steps if len(codes) > 1 else 0):
            g = rng.randrange(len(codes))
            kind, old, new = kinds[codes[g]], at[g], rng.randrange(len(names))
            if old == new:
                continue
            gain = change(kind, old, -1) + change(kind, new, 1)
            if gain <= 0 or rng.random() < 2.718281828 ** (-gain / (temperature * (1 - step / steps) * max(1.0, abs(cost)) + 1e-12)):
                shift(kind, old, -1)
                shift(kind, new, 1)
                at[g] = new
                cost += gain
                if cost < best[0]:
                    best = cost, bytearray(at)
    return best[1]


CHUNK = 4096


def search_split(rows: DataFrame, group: str, labels: str, ratios: dict[str, float], seed: int = 42, most_groups: int | None = None, **options) -> DataFrame:
    """(group, split) found by ``search``, for any number of groups; ``most_groups`` may bound it, and more raise ValueError.

    Groups are placed by size and name on the executors. What reaches the driver is their distinct kinds and a number of four bytes a group, what goes back one byte a group;
    names and rows do not. The greedy starts are one after another, so the driver's time grows with the groups.
    """
    spark = rows.sparkSession
    size = rows.groupBy(group).agg(F.count("*").alias("images"))
    if most_groups is not None and (found := size.limit(most_groups + 1).count()) > most_groups:
        raise ValueError(f"at least {found} groups to search over, {most_groups} at most")
    per = rows.select(group, F.monotonically_increasing_id().alias("i"), F.explode(labels).alias("c")).groupBy(group, "c").agg(F.countDistinct("i").alias("images"), F.count("*").alias("n"))
    vectors = per.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("c", "images", "n"))).alias("v"))
    placed = global_place(size.join(vectors, group, "left").withColumn("kind", F.to_json(F.struct("images", "v"))), [F.col("images").desc(), F.col(group)])
    kinds = [r.asDict(recursive=True) for r in placed.groupBy("kind").agg(F.first("images").alias("images"), F.first("v").alias("v")).collect()]
    numbered = spark.createDataFrame([(r["kind"], i) for i, r in enumerate(kinds)], "kind string, code int")
    found = placed.select("place", "kind").join(numbered, "kind").select("place", "code").toArrow()
    codes = np.empty(found.num_rows, np.int32)
    codes[found["place"].to_numpy()] = found["code"].to_numpy()
    del found
    split = search_codes(array("i", codes.tobytes()), [(r["images"], tuple((x["c"], (x["images"], x["n"])) for x in r["v"] or [])) for r in kinds], ratios, seed, **options)
    chunks = spark.createDataFrame([(i // CHUNK, split[i : i + CHUNK]) for i in range(0, len(split), CHUNK)], "chunk long, splits binary")
    at = F.conv(F.hex(F.substring("splits", (F.col("place") % CHUNK + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    near = placed.select(group, "place", F.floor(F.col("place") / CHUNK).alias("chunk")).join(F.broadcast(chunks), "chunk")
    return near.select(group, F.element_at(F.array(*map(F.lit, ratios)), at + 1).alias("split"))
