"""Duplicates: exact groups, near pairs on 64-bit hashes, nearest neighbours, components and group consistency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.exprs import bits_to_long, dot, hamming, total
from gaugeflow.operators.ranking import global_place
from gaugeflow.session import discard, materialise, ship


def ranked_groups(members: DataFrame, key: str, member: str, prefix: str) -> DataFrame:
    """group_id by size down then least member, for keys of two members or more."""
    sizes = members.groupBy(key).agg(F.count("*").alias("size"), F.min(member).alias("first")).where(F.col("size") > 1)
    placed = global_place(sizes, [F.col("size").desc(), F.col("first")])
    named = placed.select(key, "size", F.format_string(prefix + "_%04d", F.col("place") + 1).alias("group_id"))
    return members.join(named, key)


def exact_groups(rows: DataFrame, content: str, member: str, prefix: str = "exact") -> DataFrame:
    """group_id, size, member and sha256 of rows whose content occurs twice or more."""
    hashed = rows.select(F.col(member), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))
    return ranked_groups(hashed, "sha256", member, prefix).select("group_id", "size", member, "sha256")


def fingerprints(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, phash (components at least the median), dhash (rises, then a 0) and feature (centred, length 1; zeros if constant) of vectors of at most 64 components."""
    v = F.transform(vector, lambda x: x.cast("double"))
    d = vectors.select(F.col(key), v.alias("v"))
    ordered, n = F.sort_array("v"), F.size("v")
    median = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    d = d.withColumns({"median": median, "mean": total(F.col("v")) / n})
    d = d.withColumn("centred", F.transform("v", lambda x: x - F.col("mean"))).withColumn("norm", F.sqrt(dot(F.col("centred"), F.col("centred"))))
    rises = F.concat(F.transform(F.slice("v", 2, F.lit(63)), lambda x, i: x >= F.get("v", i)), F.array(F.lit(False)))
    return d.select(key, bits_to_long(F.transform("v", lambda x: x >= F.col("median"))).alias("phash"), bits_to_long(rises).alias("dhash"), F.transform("centred", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(F.lit(0.0))).alias("feature"))


def band_column(hash_: Column, distance: int) -> Column:
    """d + 1 disjoint runs of bits as (number, bits): two hashes within distance d agree in one of them, so joining on them loses nothing."""
    bands = distance + 1
    out, low = [], 0
    for i in range(bands):
        width = 64 // bands + (1 if i < 64 % bands else 0)
        mask = (1 << width) - 1
        out.append(F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(hash_, low).bitwiseAND(F.lit(mask)).alias("bits")))
        low += width
    return F.array(*out)


def near_pairs(prints: DataFrame, key: str, p_most: int = 6, d_most: int = 8, corr_least: float = 0.98) -> DataFrame:
    """Pairs (left < right) within both distances and of at least the correlation.

    Narrow distances join on bit bands; each pair is taken in its first common band only, so there is no distinct. Distances whose bands would be under six bits select
    nothing, and the pairs are found in blocks of rows instead.
    """
    if 64 // (p_most + 1) < 6:
        return near_pairs_blocked(prints, key, p_most, d_most, corr_least)
    banded = prints.withColumn("b", F.explode(band_column(F.col("phash"), p_most))).select("*", "b.*").drop("b")
    side = lambda s: banded.select("band", "bits", *[F.col(c).alias(f"{s}_{c}") for c in prints.columns])
    both = side("l").join(side("r"), ["band", "bits"]).where((F.col(f"l_{key}") < F.col(f"r_{key}")) & (hamming(F.col("l_phash"), F.col("r_phash")) <= p_most) & (hamming(F.col("l_dhash"), F.col("r_dhash")) <= d_most))
    same = F.filter(F.arrays_zip(band_column(F.col("l_phash"), p_most).alias("x"), band_column(F.col("r_phash"), p_most).alias("y")), lambda z: z["x"]["bits"] == z["y"]["bits"])
    both = both.where(F.col("band") == F.get(same, F.lit(0))["x"]["band"])
    return pair_columns(both, key).where(F.col("correlation") >= corr_least)


def pair_columns(both: DataFrame, key: str) -> DataFrame:
    return both.select(F.col(f"l_{key}").alias("left"), F.col(f"r_{key}").alias("right"), hamming(F.col("l_phash"), F.col("r_phash")).alias("phash_distance"), hamming(F.col("l_dhash"), F.col("r_dhash")).alias("dhash_distance"), dot(F.col("l_feature"), F.col("r_feature")).alias("correlation"))


BLOCK = 2048


def met_blocks(a: DataFrame, b: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(i, j, a, b): every block of about ``block`` rows of ``a`` beside every block of ``b``, packed into arrays; of one table (``b`` left out) every two blocks once, i <= j.

    Blocks are numbered beforehand and meet by their numbers, so no row travels alone and no side is broadcast. The work is that of all pairs, done in numpy;
    what comes out of a meeting is left to the caller.
    """
    def packed(d: DataFrame) -> tuple[DataFrame, int]:
        n = max(1, -(-d.count() // block))
        d = d.withColumn("__block", F.pmod(F.xxhash64(F.col(d.columns[0])), F.lit(n)).cast("int"))
        return materialise(d.groupBy("__block").agg(F.collect_list(F.struct(*[c for c in d.columns if c != "__block"])).alias("rows")), "blocks"), n

    left, n = packed(a)
    right, m = (left, n) if b is None else packed(b)
    partners = F.sequence(F.col("__block") if b is None else F.lit(0), F.lit(m - 1))
    asked = left.select(F.col("__block").alias("i"), F.col("rows").alias("a"), F.explode(partners).alias("j"))
    return asked.join(right.select(F.col("__block").alias("j"), F.col("rows").alias("b")), "j").select("i", "j", "a", "b")


def columns_of(rows: list[dict]) -> tuple[np.ndarray, ...]:
    return np.array([r["key"] for r in rows], np.int64), np.array([r["phash"] for r in rows], np.int64), np.array([r["dhash"] for r in rows], np.int64), np.array([r["feature"] for r in rows], np.float64)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a[:, None] ^ b[None]).view(np.uint64)).astype(np.int32)


def near_pairs_blocked(prints: DataFrame, key: str, p_most: int, d_most: int, corr_least: float, block: int = BLOCK) -> DataFrame:
    """The same pairs by comparing blocks of rows: every two blocks meet in one task, and only the pairs that qualify come out."""
    ship(prints.sparkSession)
    both = met_blocks(prints.select(F.col(key).cast("long").alias("key"), "phash", "dhash", "feature"), block=block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(len(batch)):
                row = batch.slice(n, 1).to_pylist()[0]
                ka, pa_, da, fa = columns_of(row["a"])
                kb, pb, db, fb = columns_of(row["b"])
                p, q, corr = differing(pa_, pb), differing(da, db), fa @ fb.T
                ok = (p <= p_most) & (q <= d_most) & (corr >= corr_least)
                ok &= (ka[:, None] < kb[None]) if row["i"] == row["j"] else (ka[:, None] != kb[None])
                x, y = np.nonzero(ok)
                lo, hi = np.minimum(ka[x], kb[y]), np.maximum(ka[x], kb[y])
                yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi), pa.array(p[x, y]), pa.array(q[x, y]), pa.array(corr[x, y])], ["left", "right", "phash_distance", "dhash_distance", "correlation"])

    return both.mapInArrow(run, "left long, right long, phash_distance int, dhash_distance int, correlation double")


def nearest(queries: DataFrame, candidates: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """Each query's candidate, other than itself, of highest correlation (equal to twelve digits: the smaller key) with both hash distances.

    Blocks of queries meet blocks of candidates, and of each meeting one row a query comes out.
    """
    ship(queries.sparkSession)
    named = lambda d: d.select(F.col(key).cast("long").alias("key"), "phash", "dhash", "feature")
    both = met_blocks(named(queries), named(candidates), block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(len(batch)):
                row = batch.slice(n, 1).to_pylist()[0]
                ka, pa_, da, fa = columns_of(row["a"])
                kb, pb, db, fb = columns_of(sorted(row["b"], key=lambda r: r["key"]))
                corr = np.round(fa @ fb.T, 12)
                corr[ka[:, None] == kb[None]] = -np.inf
                y = corr.argmax(1)  # the first of equals has the smallest key
                x = np.flatnonzero(corr[np.arange(len(ka)), y] > -np.inf)
                y = y[x]
                yield pa.RecordBatch.from_arrays([pa.array(ka[x]), pa.array(kb[y]), pa.array(np.bitwise_count((pa_[x] ^ pb[y]).view(np.uint64)).astype(np.int32)), pa.array(np.bitwise_count((da[x] ^ db[y]).view(np.uint64)).astype(np.int32)), pa.array(corr[x, y])], ["left", "right", "phash_distance", "dhash_distance", "correlation"])

    found = both.mapInArrow(run, "left long, right long, phash_distance int, dhash_distance int, correlation double")
    best = F.max_by(F.struct("right", "phash_distance", "dhash_distance", "correlation"), F.struct("correlation", -F.col("right")))
    return found.groupBy("left").agg(best.alias("b")).select("left", "b.*")


def components(edges: DataFrame, a: str = "left", b: str = "right") -> DataFrame:
    """(member, component): the least member that edges connect it to, for all members of edges.

    Rounds of least-label propagation with label jumping, each written to the shared folder; they end when nothing changes.
    """
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = materialise(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("member"), F.least("a", "m").alias("component")), "labels")
    labels_table = labels
    while True:
        near = both.join(labels.select(F.col("member").alias("b"), F.col("component").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        step = labels.join(near, labels["member"] == near["a"]).select("member", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        jump = labels.select(F.col("member").alias("component"), F.col("component").alias("to"))
        new = materialise(step.join(jump, "component", "left").select("member", "old", F.least("component", F.coalesce("to", "component")).alias("component")), "labels")
        done = new.where(F.col("old") != F.col("component")).isEmpty()
        discard(labels_table)
        labels_table, labels = new, new.select("member", "component")
        if done:
            discard(both)
            return labels


def group_consistency(members: DataFrame, annotations: DataFrame, group: str, member: str, label: str, missing: str = "<NO_JSON>") -> DataFrame:
    """Per group: whether its members' annotations agree in label sets and in counts. ``annotations`` has a row per label of a member; a member without rows has the label set ``missing``."""
    per = annotations.groupBy(member, label).agg(F.count("*").alias("n")).groupBy(member).agg(F.sort_array(F.collect_list(F.struct(label, "n"))).alias("s"))
    per = per.select(member, F.array_join(F.transform("s", lambda x: F.concat(x[label], F.lit(":"), x["n"].cast("string"))), "|").alias("signature"), F.array_join(F.transform("s", lambda x: x[label]), "|").alias("labels"))
    d = members.join(per, member, "left").withColumns({"has": F.col("signature").isNotNull(), "signature": F.coalesce("signature", F.lit(missing)), "labels": F.coalesce("labels", F.lit(missing))})
    out = d.groupBy(group).agg(F.count("*").alias("size"), F.countDistinct("signature").alias("signatures"), F.countDistinct("labels").alias("label_sets"), F.count_if(~F.col("has")).alias("missing"))
    return out.select(group, "size", "signatures", "label_sets", "missing", (F.col("label_sets") > 1).alias("label_mismatch"), ((F.col("label_sets") == 1) & (F.col("signatures") > 1)).alias("count_only_mismatch"))
