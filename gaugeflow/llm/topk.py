"""Exact top-k inner products by dual-tree search over cover trees.

Vectors become whole numbers; scores are their inner products, exact. Each block of at most
``block_rows`` candidates gets a cover tree: the children of a node at one level are points farther
apart than that level's covering distance, and each node knows the radius of its subtree. The queries
are indexed in the same way. A pair of nodes (query group, candidates) is pruned when the bound

    <q, c> + r_q |c| + r_c |q| + r_q r_c

on every product between them is below the worst k-th score of the group so far; pairs that survive
are split on the side of larger radius until both are leaves, whose products one matrix product gives.

Queries are taken in chunks of ``chunk_rows``, each broadcast (its size is proven) and run against all
candidates in place; every task returns its k best for each query, and the final top k merges them. So
the number of queries is not bounded, and no candidate is shuffled.

Behaviour: ids or vectors that are null, vectors with null or non-finite components and empty vectors
take no part. A component whose whole number does not fit 64 bits counts as the nearest that does, and a score beyond
2**62 - 1 either way counts as that; smaller ones are exact, however large the components. Only vectors of the same length are compared. Equal scores go to the smaller id.
A query's own row, which is every row with its id, is no candidate; repeated rows are candidates of
their own for others. Fewer candidates than k give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.session import ship

BLOCK_ROWS, CHUNK_ROWS, LEAF, GROUP, BASE = 4096, 20_000, 64, 4, 1.3
#: A score below every other; scores beyond it either way count as the next to it.
NONE = -(1 << 62)
MOST = -NONE - 1


class Node:
    __slots__ = ("center", "norm", "radius", "children", "rows")

    def __init__(self, center, radius, children, rows):
        self.center, self.radius, self.children, self.rows = center, radius, children, rows
        self.norm = float(np.sqrt(center @ center))


def cover_tree(points: np.ndarray, leaf: int = LEAF, base: float = BASE) -> Node:
    """A cover tree over the rows of ``points`` (floats), whose nodes of at most ``leaf`` rows are leaves."""
    norms = np.einsum("ij,ij->i", points, points)

    def far(rows: np.ndarray, p: int) -> np.ndarray:
        return np.sqrt(np.maximum(0, norms[rows] - 2 * (points[rows] @ points[p]) + norms[p]))

    def build(rows: np.ndarray, own: np.ndarray) -> Node:
        """``rows``: the subtree's rows, its own point first; ``own``: their distances from it."""
        radius = float(own.max()) if len(rows) else 0.0
        if len(rows) <= leaf or radius == 0:
            return Node(points[rows[0]], radius, [], rows)
        covering, left, left_own, children = radius / base, rows, own, []
        small: list[np.ndarray] = []
        while len(left):
            d = left_own if not children and not small else far(left, left[0])
            near = d <= covering
            near[0] = True
            group, distances = left[near], d[near]
            if len(group) * 8 < leaf:
                small.append(group)  # points with few others near them share nodes, below
            else:
                children.append(build(group, distances))
            left, left_own = left[~near], left_own[~near]
        loose = np.concatenate(small) if small else np.empty(0, np.int64)
        for i in range(0, len(loose), leaf):
            part = loose[i : i + leaf]
            center = points[part].mean(0)
            children.append(Node(center, float(np.sqrt(((points[part] - center) ** 2).sum(1)).max()), [], part))
        return Node(points[rows[0]], radius, children, rows)

    rows = np.arange(len(points))
    return build(rows, far(rows, 0))


class Search:
    """Top k of each query over blocks of candidates that come one after another."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.tree = cover_tree(vectors.astype(np.float64), leaf=GROUP)
        self.scores = np.full((len(ids), k), NONE)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.pruned = self.met = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        tree = cover_tree(vectors.astype(np.float64))
        largest = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
        exact = largest(self.vectors) * largest(vectors) * self.vectors.shape[1] < 2**52
        own = (self.vectors if exact else self.vectors.astype(object)), (vectors if exact else vectors.astype(object))
        self.float = [x.astype(np.float64) if exact else x for x in own]
        stack = [(self.tree, tree)]
        while stack:
            q, c = stack.pop()
            worst = self.scores[q.rows, -1].min()
            # the bound is taken in floats; a relative slack covers their rounding. No score is under -MOST
            bound = float(q.center @ c.center) + q.radius * c.norm + c.radius * q.norm + q.radius * c.radius
            if max(bound + 1e-9 * abs(bound) + 1, -MOST) < worst:
                self.pruned += 1
                continue
            if not q.children and not c.children:
                self.leaves(q.rows, c.rows, ids)
                continue
            split_q = q.children and (not c.children or q.radius * c.norm > c.radius * q.norm)
            pairs = [(x, c) for x in q.children] if split_q else [(q, x) for x in c.children]
            # the most promising pair is taken first, so that the k-th scores rise early
            pairs.sort(key=lambda p: float(p[0].center @ p[1].center) + p[1].radius * p[0].norm)
            stack.extend(pairs)

    def leaves(self, q: np.ndarray, c: np.ndarray, ids: np.ndarray) -> None:
        self.met += len(q) * len(c)
        products = self.float[0][q] @ self.float[1][c].T
        products = np.asarray(products, np.float64).astype(np.int64) if self.float[0].dtype != object else np.minimum(np.maximum(products, -MOST), MOST).astype(np.int64)
        products[self.ids[q][:, None] == ids[c][None, :]] = NONE
        hit = (products >= self.scores[q, -1][:, None]).any(1)
        rows = q[hit]
        if not len(rows):
            return
        scores = np.concatenate([self.scores[rows], products[hit]], 1)
        found = np.concatenate([self.found[rows], np.broadcast_to(ids[c], (len(rows), len(c)))], 1)
        # by score down, then id up
        order = np.lexsort((found, -scores), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(scores, order, 1)
        self.found[rows] = np.take_along_axis(found, order, 1)

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ok = self.scores > NONE
        return np.repeat(self.ids, ok.sum(1)), self.found[ok], self.scores[ok]


def quantised(vectors: DataFrame, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """(id, v): whole-number components floor(scale * x) of the vectors that take part."""
    d = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    d = d.where(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", usable))
    return d.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def matrix(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a batch, by length of the vectors."""
    ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets) - column.offsets[0].as_py()
    sizes = np.diff(ends)
    out = []
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        out.append((ids[rows], values[ends[rows][:, None] + np.arange(n)]))
    return out


def top_k(vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding", block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best; ``queries``: a condition on the id column that picks the queries."""
    spark = vectors.sparkSession
    ship(spark)
    all_rows = quantised(vectors, scale, id_column, vector_column)
    asked = quantised(vectors.where(queries), scale, id_column, vector_column)
    n = asked.count()
    parts = -(-n // chunk_rows)
    schema = "query_id long, vec_id long, score long"

    def search(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searches = {v.shape[1]: Search(ids, v, k) for ids, v in sent.value}
            held: dict[int, list] = {}

            def flush(size: int) -> None:
                ids, v = (np.concatenate(x) for x in zip(*held.pop(size), strict=True))
                for i in range(0, len(ids), block_rows):
                    searches[size].add(ids[i : i + block_rows], v[i : i + block_rows])

            for batch in batches:
                for ids, v in matrix(batch):
                    if v.shape[1] in searches:
                        held.setdefault(v.shape[1], []).append((ids, v))
                        if sum(len(x) for x, _ in held[v.shape[1]]) >= block_rows:
                            flush(v.shape[1])
            for size in list(held):
                flush(size)
            for s in searches.values():
                q, found, scores = s.results()
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.int64())], ["query_id", "vec_id", "score"])

        return all_rows.mapInArrow(run, schema)

    found = spark.createDataFrame([], schema)
    for i in range(parts):
        # chunks by hash of the id: at most about chunk_rows rows reach the driver at once
        chunk = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i) if parts > 1 else asked
        table = chunk.dropDuplicates().orderBy("id").toArrow()
        blocks = [x for batch in table.combine_chunks().to_batches() for x in matrix(batch)]
        if blocks:
            found = found.unionByName(search(spark.sparkContext.broadcast(blocks)))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
