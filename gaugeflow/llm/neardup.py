"""Near-duplicate detection by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set of shingles of five words, weight (1 + ln tf) * idf. Document frequencies come
from a count sketch over all documents of fixed size, less its mean load; the idf is saturated: a
shingle in at most ``COMMON`` of the documents weighs 1, one in more weighs ln(N/df) / ln(1/COMMON), ``FLOOR``
at least. Rare shingles are not weighed up further, since the edits that tell near copies apart are the
rarest of all and would push true copies under the threshold.

Shingles are dealt by hash into ``BINS`` bins. In each bin the shingle of least a = c exp(-r (t - b + 1)),
t = floor(ln w / r + b), r and c ~ Gamma(2, 1), b uniform, all from the shingle's hash, is the bin's sample
(with t); two texts share it with a probability of their weighted Jaccard similarity in that bin. Empty bins
borrow from the next full one. Three bins make a band; texts with an equal band are candidates.

Equal texts are one node from the start. A bucket's nodes meet in one task as whole weighted sets, and
those outside its largest class ask all others for their exact weighted Jaccard similarity; the first to
ask is the node that shares most with the rest. Only links that join two classes come out, so a bucket of m
nodes gives m - 1 pairs at most, and no link between two classes is missed. Buckets with the same nodes are one.
A bucket of more than ``NODES`` nodes (or ``ENTRIES`` shingles) is dealt into blocks. Each block meets by itself and with the bucket's leader, the
node that meets most others in all its buckets. Then only nodes outside the bucket's largest class ask the other
blocks: what the leader did not join is compared in full, block by block, since no shorter way is exact.
Nothing is capped; banding alone is probabilistic. Classes are the components of the links.

Behaviour: null text counts as empty. Texts without a word are linked to equal texts only. A text
of one to four words is one shingle. class_id is the least doc_id of the class (null only if all are);
one row is kept of each class, that of class_id. Repeated rows fall into one class. Extra columns stay.
All intermediate tables are written to the shared folder; nothing unbounded reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.common import chunks, fresh, ids_and_texts, reopened, with_small_batches, worker_release
from gaugeflow.operators import dedup as graph
from gaugeflow.session import discard, materialise, ship

SHINGLE, SIMILARITY = 5, 0.8
BINS, ROWS = 48, 3
BANDS = BINS // ROWS
SKETCH, SLICES = 1 << 17, 16
COMMON, FLOOR = 0.05, 0.75
#: Nodes and shingles of a group that meets in one task; larger buckets are dealt into such groups.
NODES, ENTRIES = 2048, 2_000_000
#: Weights are 32-bit floats: a similarity is reached if it is missed by less than this.
EPSILON = 1e-6
PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of the distinct shingles of all texts, by text."""
    split = [t.split() for t in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = np.empty(total, object)
    words[:] = [w for ws in split for w in ws]
    h = pd.util.hash_array(words, categorize=True)
    starts = np.cumsum(lengths) - lengths
    counts = np.where(lengths > 0, np.maximum(1, lengths - SHINGLE + 1), 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.repeat(starts, counts) + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    size = np.minimum(lengths, SHINGLE)[owner]
    s = size.astype(np.uint64)
    padded = np.concatenate([h, np.zeros(SHINGLE, np.uint64)])
    for j in range(SHINGLE):
        s = s * PRIME + np.where(j < size, padded[first + j], np.uint64(0))
    s = mix(s)
    # equal (text, shingle) pairs become neighbours under a hash of both
    order = np.argsort(s ^ (owner.astype(np.uint64) * PRIME))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(s)))
    s, owner = s[at], owner[at]
    order = np.argsort(owner, kind="stable")
    return owner[order], s[order], tf[order]


def cells(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shingle's two cells of the sketch."""
    return (s % np.uint64(SKETCH)).astype(np.int64), SKETCH + ((s >> np.uint64(32)) % np.uint64(SKETCH)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The sketch's two rows as shares of the documents (less the mean load), and the number of documents. 2 MB reach the driver."""
    spark = docs.sparkSession
    ship(spark)
    width = 2 * SKETCH // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_release()
        table, n = np.zeros(2 * SKETCH, np.int64), 0
        for _, texts in chunks(batches):
            _, s, _ = shingles(texts)
            for c in cells(s):
                table += np.bincount(c, minlength=2 * SKETCH)
            n += len(texts)
        if n:
            part = int(hashlib.md5(table.tobytes()).hexdigest()[:4], 16) % 64
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([part] * SLICES, pa.int32()), pa.array([n] * SLICES, pa.int64()), pa.array([table[i * width : (i + 1) * width].tobytes() for i in range(SLICES)], pa.binary())], ["slice", "part", "n", "counts"])

    schema = "slice int, part int, n long, counts binary"

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.int64)
        for x in group["counts"]:
            total += np.frombuffer(x, np.int64)
        return pd.DataFrame({"slice": [group["slice"].iloc[0]], "part": [0], "n": [int(group["n"].sum())], "counts": [total.tobytes()]})

    rows = docs.mapInArrow(count, schema).groupBy("slice", "part").applyInPandas(add, schema).groupBy("slice").applyInPandas(add, schema).orderBy("slice").collect()
    if not rows:
        return np.zeros(2 * SKETCH, np.float32), 0
    table = np.concatenate([np.frombuffer(bytes(r["counts"]), np.int64) for r in rows]).astype(np.float64)
    n = rows[0]["n"]
    for row in (slice(0, SKETCH), slice(SKETCH, None)):
        load = table[row].mean()
        table[row] -= load + 3 * np.sqrt(load)
    return (table / n).astype(np.float32), n


def weights(s: np.ndarray, tf: np.ndarray, shares: np.ndarray) -> np.ndarray:
    a, b = cells(s)
    share = np.minimum(shares[a], shares[b])
    idf = np.clip(-np.log(np.maximum(share, 1e-12)) / -np.log(COMMON), FLOOR, 1.0)
    return (1 + np.log(tf)) * idf


def samples(texts: list[str], shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin samples (texts x BINS) and whether the text has a shingle."""
    return sampled(texts, shares)[:2]


def sampled(texts: list[str], shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin samples, whether the text has a shingle, and its number of distinct shingles."""
    owner, s, tf = shingles(texts)
    out = np.zeros((len(texts), BINS), np.uint64)
    if not len(s):
        return out, np.zeros(len(texts), bool), np.zeros(len(texts), np.int64)
    uniform = lambda k: ((mix(s + np.uint64(k * int(PRIME) % (1 << 64))) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    r = -np.log(uniform(1) * uniform(2))
    c = -np.log(uniform(3) * uniform(4))
    beta = uniform(5)
    w = weights(s, tf, shares)
    t = np.floor(np.log(w) / r + beta)
    a = np.log(c) - r * (t - beta + 1)
    cell = owner * BINS + (mix(s ^ PRIME) % np.uint64(BINS)).astype(np.int64)
    least = np.full(len(texts) * BINS, np.inf)
    np.minimum.at(least, cell, a)
    won = a == least[cell]
    flat = out.reshape(-1)
    flat[cell[won]] = mix(s[won] ^ (t[won].astype(np.int64).astype(np.uint64) * PRIME)) | np.uint64(1)
    full = out != 0
    some = full.any(1)
    filled = out.copy()
    for d in range(1, BINS):
        todo = (filled == 0) & some[:, None]
        if not todo.any():
            break
        rolled = np.roll(out, -d, 1)
        filled = np.where(todo & (rolled != 0), mix(rolled + np.uint64(d)) | np.uint64(1), filled)
    return filled, some, np.bincount(owner, minlength=len(texts))


def band_keys(bins: np.ndarray) -> np.ndarray:
    """Keys (texts x BANDS) of the bands, distinct between bands."""
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(bins), BANDS)).copy()
    for j in range(ROWS):
        key = mix(key * PRIME + bins[:, j::ROWS])
    return key.astype(np.int64)


def signatures(docs: DataFrame, shares: np.ndarray) -> DataFrame:
    """doc_id, key (MD5 of the text, 16 bytes), band keys (none without a word) and the number of distinct shingles, of every row."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            bins, some, kinds = sampled(texts, sent.value)
            keys = band_keys(bins)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([hashlib.md5(t.encode()).digest() for t in texts], pa.binary()), pa.array([k if ok else [] for k, ok in zip(keys, some, strict=True)], pa.list_(pa.int64())), pa.array(kinds, pa.int64())], ["doc_id", "key", "bands", "kinds"])

    return docs.mapInArrow(run, "doc_id long, key binary, bands array<long>, kinds long")


def vectors(texts: DataFrame, shares: np.ndarray) -> DataFrame:
    """key and the whole text's weighted set: hashes (64 bits each) and weights (32-bit floats) as two byte strings."""
    sent = texts.sparkSession.sparkContext.broadcast(shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_release()
        for part, own in chunks(batches):
            owner, s, tf = shingles(own)
            w = weights(s, tf, sent.value).astype(np.float32)
            ends = np.searchsorted(owner, np.arange(len(own) + 1))
            cut = list(zip(ends, ends[1:], strict=False))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([w[a:b].tobytes() for a, b in cut], pa.binary())], ["key", "s", "w"])

    return texts.mapInArrow(run, "key binary, s binary, w binary")


def jaccard(s: np.ndarray, w: np.ndarray, s2: np.ndarray, w2: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted sparse vectors."""
    if not len(s) or not len(s2):
        return 0.0
    at = np.minimum(np.searchsorted(s2, s), len(s2) - 1)
    same = s2[at] == s
    common = np.minimum(w[same], w2[at[same]]).sum()
    return float(common / (w.sum() + w2.sum() - common))


class Sets:
    """Weighted sets that can be asked for their similarity to all of them at once, by an index from shingles to sets."""

    def __init__(self, rows: list[tuple[bytes, bytes]]):
        s = [np.frombuffer(x, np.uint64) for x, _ in rows]
        sizes = np.fromiter(map(len, s), np.int64, len(s))
        self.n, self.ends = len(rows), np.concatenate([[0], np.cumsum(sizes)])
        self.w = np.concatenate([np.frombuffer(x, np.float32) for _, x in rows]).astype(np.float64)
        owner = np.repeat(np.arange(self.n), sizes)
        self.total = np.bincount(owner, self.w, self.n)
        self.column = np.unique(np.concatenate(s), return_inverse=True)[1]
        order = np.argsort(self.column, kind="stable")
        self.posted, self.weight = owner[order], self.w[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.column))])

    def similarities(self, x: int) -> np.ndarray:
        own = slice(self.ends[x], self.ends[x + 1])
        first, sizes = self.starts[self.column[own]], np.diff(self.starts)[self.column[own]]
        at = np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
        common = np.bincount(self.posted[at], np.minimum(self.weight[at], np.repeat(self.w[own], sizes)), self.n)
        return common / np.maximum(self.total[x] + self.total - common, 1e-300)


def linked(sets: Sets, classes: np.ndarray, asks: np.ndarray, asked: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Links (x, y), x of ``asks`` and y of ``asked``, that join all classes which have one of at least ``similarity``.

    Every set outside the largest class asks, in turn; a class that grows to be the largest stops asking. So of two sets in different classes one has asked.
    """
    classes = classes.copy()
    sizes = Counter(classes.tolist())
    # the set that meets the most others asks first: it joins most of what can be joined
    kinds = np.diff(sets.ends)
    degree = np.bincount(np.repeat(np.arange(sets.n), kinds), np.diff(sets.starts)[sets.column], sets.n) / np.maximum(kinds, 1)
    order = np.flatnonzero(asks)
    order = order[np.argsort(-degree[order], kind="stable")].tolist()
    # the caller left its largest class out of those that ask, or nobody is left out and the largest class is looked at here
    spared = max(sizes, key=sizes.__getitem__) if asks.all() else None
    while order and len(sizes) > 1:
        later = []
        for turn, x in enumerate(order):
            if len(sizes) < 2:
                return
            if spared is not None and turn and classes[x] == spared:
                later.append(x)
                continue
            near = sets.similarities(x) >= similarity - EPSILON
            for y in np.flatnonzero(near & asked & (classes != classes[x])):
                a, b = int(classes[x]), int(classes[y])
                if a != b:
                    yield int(x), int(y)
                    small, large = (a, b) if sizes[a] < sizes[b] else (b, a)
                    classes[classes == small] = large
                    sizes[large] += sizes.pop(small)
                    if spared is not None and (spared == small or sizes[large] > sizes[spared]):
                        spared = large
        # who was spared as one of the largest class asks after all if another class has become the largest
        order = [x for x in later if classes[x] != spared]


def links_within(groups: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b), a > b, of the groups of rows with equal band, i and j, which lie together; columns band, i, j, key, comp, asks, asked, s, w."""

    def found(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        keys, comps, asks, asked, s, w = zip(*rows, strict=True)
        classes = np.unique(np.array(comps, object).astype("S16"), return_inverse=True)[1]
        if len(rows) < 2 or not classes.any():
            return []
        sets = Sets(list(zip(s, w, strict=True)))
        pairs = linked(sets, classes, np.array(asks), np.array(asked), similarity)
        return [(max(keys[x], keys[y]), min(keys[x], keys[y])) for x, y in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_release()
        at, held = None, []

        def out() -> pa.RecordBatch:
            pairs = found(held) if held else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.binary()), pa.array([b for _, b in pairs], pa.binary())], ["a", "b"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for band, i, j, *row in zip(*columns, strict=True):
                if (band, i, j) != at:
                    yield out()
                    at, held = (band, i, j), []
                held.append(tuple(row))
        yield out()

    return groups.select("band", "i", "j", "key", "comp", "asks", "asked", "s", "w").mapInArrow(run, "a binary, b binary").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(key, comp) of every node of the edges: the least key of its component."""
    return graph.components(edges, "a", "b").select(F.col("member").alias("key"), F.col("component").alias("comp"))


def blocks(members: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups that meet first: small buckets whole, large ones in blocks, each with the bucket's leader; and the members of large buckets alone, with their block.

    ``members`` has band, key, s and w; ``chosen`` band, n and blocks.
    """
    placed = members.join(chosen, "band").withColumn("j", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    columns = ["band", F.lit(0).alias("i"), "j", "key", F.col("key").alias("comp"), F.lit(True).alias("asks"), F.lit(True).alias("asked"), "s", "w"]
    large = placed.where(F.col("blocks") > 1)
    met = members.select("band", "key").join(chosen, "band").groupBy("key").agg(F.sum("n").alias("met"))
    leader = large.select("band", "key", "j", "blocks").join(met, "key").groupBy("band").agg(F.max_by(F.struct("key", "j", "blocks"), F.struct("met", "key")).alias("x")).select("band", "x.*")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("j"))
    copies = leader.select("band", "key", F.explode(others).alias("j")).join(members, ["band", "key"])
    return placed.select(*columns).unionByName(copies.select(*columns)), large.select("band", "j", "key", "s", "w")


def meetings(large: DataFrame, classes: DataFrame) -> DataFrame:
    """Groups (band, i, j) of block i of the nodes outside the bucket's largest class, which ask, and block j of all nodes, which are asked. Buckets of one class have none."""
    d = large.join(classes, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    per = d.groupBy("band", "comp").agg(F.count("*").alias("n"))
    sizes = per.groupBy("band").agg(F.max(F.struct("n", "comp")).alias("x"), F.sum("n").alias("n"))
    last = d.groupBy("band").agg((F.max("j") + 1).alias("blocks"))
    # as many blocks of those that ask as their part of the bucket's blocks
    asking = F.ceil((F.col("n") - F.col("x.n")) / F.col("n") * F.col("blocks")).cast("int")
    mixed = sizes.join(last, "band").where(F.col("n") > F.col("x.n")).select("band", F.col("x.comp").alias("largest"), asking.alias("asking"), "blocks")
    d = d.join(mixed, "band").withColumns({"i": F.pmod(F.xxhash64("key", F.lit(1)), "asking").cast("int"), "asks": F.col("comp") != F.col("largest")})
    role = lambda i, j, asks, asked: F.struct(i.alias("i"), j.alias("j"), asks.alias("asks"), F.lit(asked).alias("asked"))
    own = F.transform(F.sequence(F.lit(0), F.col("asking") - 1), lambda i: role(i, F.col("j"), F.col("asks") & (i == F.col("i")), True))
    away = F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.col("asks") & (j != F.col("j"))), lambda j: role(F.col("i"), j, F.lit(True), False))
    return d.select("band", F.explode(F.concat(own, away)).alias("x"), "key", "comp", "s", "w").select("band", "x.*", "key", "comp", "s", "w")


def together(groups: DataFrame) -> DataFrame:
    return groups.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")


def links(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, key), nodes (key, rep) and classes (key, comp) of the nodes that have links. ``docs`` has doc_id and text."""
    shares, _ = document_frequencies(docs)
    signed = materialise(signatures(docs, shares), "dup-signatures")
    one = F.first(F.struct("bands", "kinds"))
    nodes = materialise(signed.groupBy("key").agg(F.min("doc_id").alias("rep"), one.alias("x")).select("key", "rep", "x.*"), "dup-nodes")
    placed = nodes.select("key", "kinds", F.explode("bands").alias("band"))
    # the nodes of a bucket by two hashes: buckets of the same nodes are one
    same = [F.bit_xor(F.xxhash64("key", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    buckets = placed.groupBy("band").agg(F.count("*").alias("n"), F.sum("kinds").alias("kinds"), *same).where(F.col("n") > 1)
    parts = F.greatest(F.ceil(F.col("n") / NODES), F.ceil(F.col("kinds") / ENTRIES)).cast("int")
    chosen = materialise(buckets.groupBy("n", "x1", "x2").agg(F.min("band").alias("band"), F.max("kinds").alias("kinds")).select("band", "n", parts.alias("blocks")), "dup-buckets")
    members = materialise(placed.select("band", "key").join(chosen.select("band"), "band"), "dup-members")
    wanted = nodes.join(members.select("key").distinct(), "key", "left_semi").select(F.coalesce("rep", F.lit(-1 << 63)).alias("rep"), F.lower(F.hex("key")).alias("hex"), "key")
    named = docs.select(F.coalesce("doc_id", F.lit(-1 << 63)).alias("rep"), F.md5(F.col("text").cast("binary")).alias("hex"), "text")
    # rows of one id and text are alike; one of them is enough
    texts = named.join(wanted, ["rep", "hex"]).select("key", "text").dropDuplicates(["key"])
    sets = materialise(vectors(texts, shares), "dup-sets", wide=True)
    # a set may be large: few of them to a batch
    apart = with_small_batches(docs.sparkSession, 512)
    full = reopened(members, apart).join(reopened(sets, apart), "key")
    first, large = blocks(full, reopened(chosen, apart))
    edges = materialise(links_within(together(first), similarity), "dup-links")
    classes = components(reopened(edges, docs.sparkSession))
    if not chosen.where(F.col("blocks") > 1).isEmpty():
        known = materialise(classes, "dup-classes")
        more = materialise(links_within(together(meetings(large, reopened(known, apart))), similarity), "dup-links")
        if not more.isEmpty():
            classes = components(reopened(edges, docs.sparkSession).unionByName(reopened(more, docs.sparkSession)))
        discard(more)
    discard(chosen, members, sets, edges)
    return signed.select("doc_id", "key"), nodes.select("key", "rep"), classes


def classes(docs: DataFrame, similarity: float = SIMILARITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, class_id (least doc_id of its class) and class_size (rows) of every row."""
    rows, nodes, linked = links(ids_and_texts(docs, id_column, text_column), similarity)
    named = nodes.join(linked, "key", "left").select("key", "rep", F.coalesce("comp", "key").alias("comp"))
    counted = rows.groupBy("key").agg(F.count("*").alias("n"))
    ids = named.join(counted, "key").groupBy("comp").agg(F.min("rep").alias("class_id"), F.sum("n").alias("class_size"))
    return rows.join(named.join(ids, "comp").select("key", "class_id", "class_size"), "key").select("doc_id", "class_id", "class_size")


def dedup(docs: DataFrame, similarity: float = SIMILARITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the one whose id is the class id, and of rows of one id and text one."""
    rows, nodes, linked = links(ids_and_texts(docs, id_column, text_column), similarity)
    named = nodes.join(linked, "key", "left").select("key", "rep", F.coalesce("comp", "key").alias("comp"))
    lowest = F.min(F.struct(F.col("rep").isNull().alias("no"), F.col("rep").alias("rep"), F.col("key").alias("key")))
    rep, text_key, place = (fresh(docs, x) for x in ("__rep", "__text_key", "__place"))
    kept = materialise(named.groupBy("comp").agg(lowest.alias("x")).select(F.coalesce("x.rep", F.lit(-1 << 63)).alias(rep), F.lower(F.hex("x.key")).alias(text_key)), "dup-kept")
    named_docs = docs.withColumns({rep: F.coalesce(F.col(id_column).cast("long"), F.lit(-1 << 63)), text_key: F.md5(F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary"))})
    out = named_docs.join(kept, [rep, text_key], "left_semi")
    repeated = rows.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    if not repeated.isEmpty():
        first = Window.partitionBy(rep, text_key).orderBy(*[F.col(f"`{c}`").cast("string") for c in docs.columns])
        out = out.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    return out.select(*[f"`{c}`" for c in docs.columns])
