"""Links of buckets against all pairs, in one block and in many; recall over a whole table; what the saturated idf changes."""

import random

import numpy as np
import pyarrow.parquet as pq

from gaugeflow.llm import neardup

SF = "/root/testdata/sf0.1"


def components(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        lo, hi = sorted((label[a], label[b]))
        label = [lo if x == hi else x for x in label]
    return label


def family(seed, members=60, words=80, most=24):
    """Texts at very different distances from one base, so that a bucket holds linked and unlinked ones."""
    rng = random.Random(seed)
    base = [f"v{rng.randrange(4000)}" for _ in range(words)]
    texts = []
    for _ in range(members):
        w = list(base)
        for _ in range(rng.randrange(most)):
            w[rng.randrange(words)] = f"e{rng.randrange(9999)}"
        texts.append(" ".join(w))
    return list(dict.fromkeys(texts))


def sets_of(texts, shares=None):
    shares = np.full(2 * neardup.SKETCH, -1, np.float32) if shares is None else shares
    owner, s, tf = neardup.shingles(texts)
    return sets_from(owner, s, neardup.weights(s, tf, shares), len(texts))


def sets_from(owner, s, w, n):
    ends = np.searchsorted(owner, np.arange(n + 1))
    return neardup.Sets([(s[a:b].tobytes(), w[a:b].astype(np.float32).tobytes()) for a, b in zip(ends, ends[1:], strict=False)])


def all_pairs(sets, least=0.8):
    return [(x, int(y)) for x in range(sets.n) for y in np.flatnonzero(sets.similarities(x) >= least - neardup.EPSILON) if x < y]


def test_similarities_equal_the_plain_formula():
    sets = sets_of([*family(1, 12), "one two one two one two one two", "a b"])
    for x in range(sets.n):
        found = sets.similarities(x)
        own = dict(zip(sets.column[sets.ends[x] : sets.ends[x + 1]], sets.w[sets.ends[x] : sets.ends[x + 1]], strict=True))
        for y in range(sets.n):
            other = dict(zip(sets.column[sets.ends[y] : sets.ends[y + 1]], sets.w[sets.ends[y] : sets.ends[y + 1]], strict=True))
            common = sum(min(v, other.get(k, 0)) for k, v in own.items())
            assert abs(found[y] - common / (sum(own.values()) + sum(other.values()) - common)) < 1e-9


def test_links_join_what_all_pairs_join():
    for seed in range(12):
        sets = sets_of(family(seed, 40 + seed, 60 + 5 * seed, 6 + 2 * seed))
        every = np.ones(sets.n, bool)
        found = list(neardup.linked(sets, np.arange(sets.n), every, every, 0.8))
        pairs = all_pairs(sets)
        assert components(sets.n, found) == components(sets.n, pairs) and set(map(tuple, map(sorted, found))) <= set(pairs)
        assert len(found) == sets.n - len(set(components(sets.n, pairs)))
        # some ask, all but some are asked: every link between an asking and an asked one of two classes
        rng = np.random.default_rng(seed)
        asks, asked, classes = rng.random(sets.n) < 0.5, rng.random(sets.n) < 0.7, rng.integers(0, 9, sets.n)
        found = list(neardup.linked(sets, classes, asks, asked, 0.8))
        some = [(x, y) for x, y in pairs if (asks[x] and asked[y]) or (asks[y] and asked[x])]
        same = [(int(np.flatnonzero(classes == c)[0]), int(x)) for c in np.unique(classes) for x in np.flatnonzero(classes == c)]
        assert components(sets.n, found + same) == components(sets.n, some + same)


def test_large_buckets_in_blocks_lose_nothing(spark, monkeypatch):
    texts = [t for seed in range(3) for t in family(seed)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shares, _ = neardup.document_frequencies(d)
    sets = sets_of(texts, shares)
    pairs = all_pairs(sets)
    assert 3 < len(set(components(sets.n, pairs))) < sets.n
    one = {r["doc_id"]: r["class_id"] for r in neardup.classes(d).collect()}
    monkeypatch.setattr(neardup, "NODES", 7)
    many = {r["doc_id"]: r["class_id"] for r in neardup.classes(d).collect()}
    assert many == one == dict(enumerate(components(sets.n, pairs)))


def test_recall_over_a_whole_table(spark):
    """Every linked pair of the table by brute force; the contract asks for 0.9 of an index, and all are found."""
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    ids, texts = rows["doc_id"].to_pylist(), [t or "" for t in rows["text"].to_pylist()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    shares, _ = neardup.document_frequencies(docs)
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    nodes = list(dict.fromkeys(texts))
    first = {t: i for i, t in reversed(list(zip(ids, texts, strict=True)))}
    assert all(found[i] == found[first[t]] for i, t in zip(ids, texts, strict=True))
    pairs = all_pairs(sets_of(nodes, shares))
    held = sum(found[first[nodes[a]]] == found[first[nodes[b]]] for a, b in pairs)
    print(held, "of", len(pairs))
    assert held == len(pairs) > 0
    assert len(set(found.values())) == len(set(components(len(nodes), pairs)))


def test_what_the_saturated_idf_changes(spark):
    """Links by plain five-word Jaccard similarity of 0.8 against those of the setting in use and of the full idf, on families with a passage in common. The README has the figures of sf0.1."""
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [t + " " + passage for seed in range(8) for t in family(seed, 12, 120, 8)] + [f"{passage} alone {i}" for i in range(200)]
    shares, _ = neardup.document_frequencies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    owner, s, tf = neardup.shingles(texts)
    a, b = neardup.cells(s)
    share = np.maximum(np.minimum(shares[a], shares[b]), 1 / len(texts))

    def pairs(weight):
        return {(x, y) for x, y in all_pairs(sets_from(owner, s, weight, len(texts))) if x < 8 * 12}

    truth = pairs(np.ones(len(s)))
    recall = {}
    for name, common, floor, top in (("used", neardup.COMMON, neardup.FLOOR, 1.0), ("full", 1 / np.e, 0.0, np.inf)):
        recall[name] = len(pairs((1 + np.log(tf)) * np.clip(-np.log(share) / -np.log(common), floor, top)) & truth) / len(truth)
    print(len(truth), recall)
    assert recall["used"] > recall["full"] and recall["used"] >= 0.8
