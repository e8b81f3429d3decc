"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source's rows, in a fixed pseudo-random order, make blocks of ``block_rows`` rows. With weight w,
block j (from 0) is released at slot floor(j / w) and due by slot ceil((j + 1) / w). Every slot goes
to the released block with the earliest deadline; then after any number of slots each source has had
its share to less than one block. Weights are whole numbers of shares out of their sum P, so the
schedule repeats after P slots: one period is computed once (P entries, a parameter) and every block
finds its slot by arithmetic, in parallel: slot = P * (j div shares) + place of (j mod shares).

Rows keep their whole content and none is dropped or repeated. When a source has no blocks left its
slots stay empty and the others go on in order, so up to the first such slot the mix holds the target
weights to less than a block.

Behaviour: a null source is a source of its own; a source that the weights do not name, and one of
weight 0, comes after all scheduled rows, in the same pseudo-random order. Equal rows are told apart by
nothing and may swap places. An empty table stays empty. Columns other than the source and
the id ride along; slot and place are added under names that do not clash (``mix_slot_`` if there is a ``mix_slot``), as the last two columns.
A hot source is numbered in ``2**bits`` slices of its own hash range, so no task sorts it whole.
"""

from __future__ import annotations

import heapq
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.common import fresh

BLOCK_ROWS, BITS, SHARES = 16, 8, 1000
#: Rows of a table that may be broadcast.
MOST_SENT = 1 << 17


def schedule(shares: dict[str | None, int]) -> list[tuple[str | None, int, int]]:
    """One period: (source, index of its block within the period, slot)."""
    divisor = gcd(*shares.values()) if shares else 1
    weights = {s: n // divisor for s, n in shares.items() if n > 0}
    period = sum(weights.values())
    order = {s: i for i, s in enumerate(sorted(weights, key=lambda x: (x is None, x or "")))}
    waiting = [(0, order[s], s, 0) for s in weights]  # release, source, block
    heapq.heapify(waiting)
    ready: list = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, i, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // weights[s]), i, s, j))
        due, i, s, j = heapq.heappop(ready)
        out.append((s, j, slot))
        if j + 1 < weights[s]:
            heapq.heappush(waiting, ((j + 1) * period // weights[s], i, s, j + 1))
    return out


def target_shares(docs: DataFrame, source_column: str = "source", power: float = 0.5, shares: int = SHARES) -> dict[str | None, int]:
    """Shares in proportion to (rows of the source) ** ``power``, by largest remainder, 1 at least. One row a source reaches the driver."""
    counts = {r["s"]: r["n"] for r in docs.groupBy(F.col(source_column).cast("string").alias("s")).agg(F.count("*").alias("n")).collect()}
    names = sorted(counts, key=lambda x: (x is None, x or ""))
    shares = max(shares, len(names))
    total = sum(n**power for n in counts.values()) or 1.0
    exact = {s: (shares - len(names)) * counts[s] ** power / total for s in names}
    out = {s: 1 + int(exact[s]) for s in names}
    for s in sorted(names, key=lambda s: int(exact[s]) - exact[s])[: shares - sum(out.values())]:
        out[s] += 1
    return out


def hash64(column: str) -> Column:
    """A 60-bit hash that other SQL engines can compute too: the head of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, shares: dict[str | None, int] | None = None, block_rows: int = BLOCK_ROWS, source_column: str = "source", id_column: str = "doc_id", bits: int = BITS, slot_column: str = "mix_slot", place_column: str = "mix_place") -> DataFrame:
    """``docs`` with ``mix_slot`` (from 0) and ``mix_place`` (row within its block); null slot: not scheduled. Order by both for the mix."""
    spark = docs.sparkSession
    shares = target_shares(docs, source_column) if shares is None else shares
    period = schedule(shares)
    length = len(period)
    counted = {s: sum(1 for x in period if x[0] == s) for s in shares}
    source, hashed, sliced, n, before, i, row, block, w, j, at, places = (fresh(docs, f"__{x}") for x in ("source", "hash", "slice", "n", "before", "i", "row", "block", "shares", "j", "at", "places"))
    slot_column, place_column = fresh(docs, slot_column), fresh(docs, place_column)
    d = docs.withColumns({source: F.coalesce(F.concat(F.lit("s"), F.col(source_column).cast("string")), F.lit("")), hashed: hash64(id_column)})
    d = d.withColumn(sliced, F.shiftright(hashed, 60 - bits))
    sizes = d.groupBy(source, sliced).agg(F.count("*").alias(n))
    earlier = Window.partitionBy(source).orderBy(sliced).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(source, sliced, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    within = Window.partitionBy(source, sliced).orderBy(hashed, F.col(id_column))
    d = d.withColumn(i, F.row_number().over(within) - 1)
    # sizes has 2**bits rows a source at most
    d = d.join(F.broadcast(sizes) if len(shares) << bits <= MOST_SENT else sizes, [source, sliced], "left").withColumn(row, F.col(before) + F.col(i))
    d = d.withColumn(block, F.floor(F.col(row) / block_rows))
    table = spark.createDataFrame([("" if s is None else f"s{s}", counted[s], k, slot) for s, k, slot in period] or [("-", 1, 0, 0)], f"{source} string, {w} long, {j} long, {at} long")
    turns = table.groupBy(source).agg(F.first(w).alias(w), F.sort_array(F.collect_list(F.struct(j, at)))[at].alias(places))
    d = d.join(F.broadcast(turns) if length <= MOST_SENT else turns, source, "left")
    slot = F.floor(F.col(block) / F.col(w)) * length + F.get(F.col(places), F.pmod(block, w).cast("int"))
    d = d.withColumns({slot_column: slot.cast("long"), place_column: F.when(F.col(w).isNotNull(), F.pmod(F.col(row), F.lit(block_rows))).otherwise(F.col(row)).cast("long")})
    return d.select(*[f"`{c}`" for c in docs.columns], slot_column, place_column)


def ordered(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in the order of the mix: its files, written as they lie, follow one another in it. Rows without a slot come last.

    Rows travel twice: to be numbered within slices of their source, and to their range of slots and places.
    """
    mixed = mix(docs, **options)
    slot, place = mixed.columns[-2:]
    order = [F.col(slot).asc_nulls_last(), F.col(place), F.col(mixed.columns[0])]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).select(*[f"`{c}`" for c in docs.columns])
