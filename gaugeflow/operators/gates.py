"""Gates: artifact manifests, freeze checks, canonical hashes and expectation suites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def artifact_manifest(required: DataFrame, found: DataFrame, key: str, content: str, head: str) -> DataFrame:
    """Status of every required artifact: missing, empty, bad_head (its content does not begin as it must) or ok."""
    d = required.select(key).join(found.select(key, F.col(content).alias("__c"), F.lit(True).alias("__there")), key, "left")
    status = F.when(F.col("__there").isNull(), "missing").when(F.coalesce(F.length("__c"), F.lit(0)) == 0, "empty").when(~F.col("__c").startswith(F.lit(head)), "bad_head").otherwise("ok")
    return d.select(key, status.alias("status"))


def row_digest(columns: list[str]) -> Column:
    """A digest of one row's canonical form: name=value in order of name, nulls as \\N."""
    return F.sha2(F.concat_ws("\u001f", *[F.concat(F.lit(c + "="), F.coalesce(F.col(c).cast("string"), F.lit("\\N"))) for c in sorted(columns)]), 256)


def table_digest(rows: DataFrame) -> DataFrame:
    """rows, and a digest of the multiset of rows that depends on neither order nor partitioning: sums of four 60-bit pieces of the rows' digests.

    Sums merge in any order, so no task sees all rows; decimals hold them without overflow.
    """
    d = rows.select(row_digest(rows.columns).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return d.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[F.coalesce(p, F.lit(0)).cast("string") for p in parts]), 256).alias("digest"))


def expectations(checks: dict[str, DataFrame]) -> DataFrame:
    """One row a check: its violating rows and whether it passed. A check is a table that must be empty."""
    out = None
    for name in sorted(checks):
        one = checks[name].agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations", (F.col("violations") == 0).alias("passed"))
        out = one if out is None else out.unionByName(one)
    return out


def freeze_checks(manifest: DataFrame, lines: DataFrame, covered: DataFrame, classes: list, stem: str = "stem", split: str = "split", sha: str = "sha256", group: str = "group_id") -> dict[str, DataFrame]:
    """The tables that must be empty before a split is frozen, by the type of issue (fixed values).

    ``lines`` are parsed label lines (stem, split, class_id, problem), ``covered`` the classes (class_id) that the check sample shows.
    """
    leak = lambda k: manifest.groupBy(k).agg(F.countDistinct(split).alias("n")).where(F.col("n") > 1)
    per = manifest.groupBy(split).agg(F.countDistinct(stem).alias("images"))
    labels = lines.groupBy(split).agg(F.countDistinct(stem).alias("labels"))
    pairs = per.join(labels, split, "full_outer").where(~F.col("images").eqNullSafe(F.col("labels")))
    wanted = manifest.sparkSession.createDataFrame([(c,) for c in classes], "class_id int")
    return {
        "pair_count": pairs, "missing_label": manifest.join(lines.select(stem).distinct(), stem, "left_anti"), "invalid_label": lines.where(F.col("problem").isNotNull()).select(stem).distinct(),
        "sha256_leakage": leak(sha), "group_leakage": leak(group), "overlay_class_coverage": wanted.join(covered.select(F.col("class_id").cast("int").alias("class_id")).distinct(), "class_id", "left_anti"),
    }


def gate_chain(observed: DataFrame, gates: list[tuple[str, str, object]]) -> DataFrame:
    """(place, gate, expected, found, status) of a chain of equalities over one row of facts: passed, failed, or not_reached after the first that failed. ``gates`` are (name, column, expected).

    A fact that is null fails its gate.
    """
    facts = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(name).alias("gate"), F.lit(str(want)).alias("expected"), F.col(column).cast("string").alias("found")) for i, (name, column, want) in enumerate(gates)])
    d = observed.limit(1).select(F.explode(facts).alias("x")).select("x.*").withColumn("ok", F.coalesce(F.col("found") == F.col("expected"), F.lit(False)))
    first = F.min(F.when(~F.col("ok"), F.col("place"))).over(Window.partitionBy())  # as many rows as gates
    status = F.when(first.isNull() | (F.col("place") < first), "passed").when(F.col("place") == first, "failed").otherwise("not_reached")
    return d.select("place", "gate", "expected", "found", status.alias("status"))


def reproduction(a: DataFrame, b: DataFrame, epoch: str, columns: list[str]) -> DataFrame:
    """Epochs of two curves whose patterns of non-finite columns differ, or which only one has."""
    bad = lambda d, n: d.select(epoch, F.sort_array(F.filter(F.array(*[F.when(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), F.lit(c)) for c in columns]), lambda x: x.isNotNull())).alias(n))
    return bad(a, "bad_a").join(bad(b, "bad_b"), epoch, "full_outer").where(~F.col("bad_a").eqNullSafe(F.col("bad_b")))
