"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Every word enters as its own embedding (if it was seen in training) beside the mean embedding of its
hashed character trigrams (always). Words and trigrams that occur in toxic texts beyond chance start
from how far beyond. A gated recurrent unit reads a window of ``WINDOW`` words in each
direction; attention weights pool the states, and a linear unit gives the window's logit. Windows
overlap by half and cover the whole text; the text's logit is its windows' highest, and two numbers fitted
on the training texts turn it into a probability.

``trained`` fits in one task on a bounded sample of labelled rows (``SAMPLE_ROWS`` of lowest hash of the id, as many of them as have ``SAMPLE_CHARS`` characters together). A toxic text does not
say where it is toxic, so each pass trains on its highest window, at first the one with the word that
most favours toxic texts; of other texts the highest windows and some at random are trained on. A fifth of the
rows is kept apart to choose the pass and to calibrate the score.

Behaviour: null text counts as empty, which is one window of padding; its score is the network's. Without
labelled rows of both classes the score is the share of toxic rows (0 without rows). An empty table gives an empty
result, a very long text as many windows as it needs. Ties, repeated rows and extra columns, whatever their names, change nothing. Scoring happens in the rows' own partitions, without a shuffle.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import bounded_ids, chunks, ids_and_texts, map_rows, worker_object, worker_release
from gaugeflow.llm.neardup import mix, shingles
from gaugeflow.session import ship

SAMPLE_ROWS, SAMPLE_CHARS, MAX_WORDS = 4000, 20_000_000, 20_000
WINDOW, STEP, HIDDEN, EMBED, TRIGRAM_BITS, ATTEND = 24, 12, 8, 8, 15, 8
TRIGRAMS = 1 << TRIGRAM_BITS
CACHE = 120_000
#: Letters of a token; a longer word is several.
LONGEST = 48
STRIP = ".,;:!?\"'()[]{}*#$%&|<>-_"


def normal(word: str) -> str:
    return word.lower().strip(STRIP)


def tokens(text: str) -> list[str]:
    """The words of a text, in training and scoring alike; words of more than LONGEST letters are cut into as many tokens as they need."""
    words = text.split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all byte trigrams of the words, ends marked, and how many each word has (one at least)."""
    marked = [f"^{w}$$".encode() if len(w) < 2 else f"^{w}$".encode() for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    letters = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    if len(letters) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = (letters[:-2] * np.uint32(65_599) + letters[1:-1]) * np.uint32(65_599) + letters[2:]
    mixed = (mixed * np.uint32(2_654_435_761)) >> np.uint32(32 - TRIGRAM_BITS)
    ends = np.cumsum(sizes)
    inside = np.ones(len(letters), bool)
    inside[ends - 1] = inside[ends - 2] = False
    return mixed[inside[:-2]].astype(np.int64), sizes - 2


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def window_starts(n: int) -> np.ndarray:
    """First words of the windows of a text of ``n`` words: every STEP words until the end is covered."""
    return np.arange(0, max(1, n - WINDOW + STEP), STEP)


class Network:
    """Parameters and their gradients. Shapes: words V x E, trigrams T x E, per direction 2E x 3H, H x 3H, 3H."""

    def __init__(self, words: dict[str, int], seed: int = 7):
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.words = words
        self.p = {"word": (0.1 * rng.standard_normal((len(words) + 1, EMBED))).astype(np.float32), "tri": (0.1 * rng.standard_normal((TRIGRAMS, EMBED))).astype(np.float32)}
        for d in ("f", "b"):
            self.p |= {f"x{d}": init(2 * EMBED, 3 * HIDDEN), f"h{d}": init(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"att": init(2 * HIDDEN, ATTEND), "key": init(ATTEND), "out": init(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        self.p["word"][0] = 0
        self.scale, self.shift, self.constant = 1.0, 0.0, None

    def inputs(self, tokens: list[str]) -> np.ndarray:
        """Inputs (n x 2E) of normalised words."""
        grams, sizes = trigrams(tokens)
        known = np.fromiter((self.words.get(w, 0) for w in tokens), np.int64, len(tokens))
        means = np.add.reduceat(self.p["tri"][grams], np.cumsum(sizes) - sizes) / sizes[:, None]
        return np.concatenate([self.p["word"][known], means], 1).astype(np.float32)

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"x{d}"] + self.p[f"c{d}"] for d in "fb"}

    def all_gates(self, tokens: list[str], part: int = 20_000) -> dict[str, np.ndarray]:
        """Gates of many words, taken in parts to bound what lies beside the result."""
        parts = [self.gates(self.inputs(tokens[i : i + part])) for i in range(0, len(tokens), part)]
        return {d: np.concatenate([p[d] for p in parts]) for d in "fb"}

    def states(self, gates: dict[str, np.ndarray], index: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """States (steps x B x 2H) of windows given as rows of ``gates``; masked steps leave the state as it is."""
        b, steps = index.shape
        out = np.zeros((steps, b, 2 * HIDDEN), np.float32)
        trace: dict = {"f": [None] * steps, "b": [None] * steps}
        full = mask.all(0)
        for d, order, at in (("f", range(steps), slice(0, HIDDEN)), ("b", range(steps - 1, -1, -1), slice(HIDDEN, 2 * HIDDEN))):
            u, h = self.p[f"h{d}"], np.zeros((b, HIDDEN), np.float32)
            for t in order:
                g, s = gates[d][index[:, t]], h @ u
                zr = sigmoid(g[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                n = np.tanh(g[:, 2 * HIDDEN :] + r * s[:, 2 * HIDDEN :])
                new = n + z * (h - n)
                if not full[t]:
                    new = np.where(mask[:, t, None], new, h)
                if keep:
                    trace[d][t] = (h, z, r, n, s[:, 2 * HIDDEN :])
                h = out[t, :, at] = new
        return out, trace

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        a = np.tanh(states @ self.p["att"])
        e = np.where(mask.T, a @ self.p["key"], np.float32(-1e9))
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = np.einsum("tb,tbh->bh", w, states)
        return pooled @ self.p["out"] + self.p["bias"][0], a, w, pooled

    def logits(self, gates: dict[str, np.ndarray], index: np.ndarray, mask: np.ndarray, batch: int = 4096) -> np.ndarray:
        return np.concatenate([self.pool(self.states(gates, index[i : i + batch], mask[i : i + batch])[0], mask[i : i + batch])[0] for i in range(0, len(index), batch)])

    def gradients(self, word_ids: np.ndarray, tri_ids: np.ndarray, tri_share: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of a batch: word ids B x W, trigram ids and shares B x W x G."""
        p, (b, steps) = self.p, word_ids.shape
        x = np.concatenate([p["word"][word_ids], np.einsum("bwg,bwge->bwe", tri_share, p["tri"][tri_ids])], 2)
        flat = x.reshape(b * steps, -1)
        index = np.arange(b * steps).reshape(b, steps)
        s, trace = self.states(self.gates(flat), index, mask, keep=True)
        logit, a, w, pooled = self.pool(s, mask)
        prob = sigmoid(logit)
        loss = -float((weight * (y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7))).sum() / weight.sum())
        d_logit = (weight * (prob - y) / weight.sum()).astype(np.float32)
        g = {"out": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_s = w[:, :, None] * d_pooled
        d_w = np.einsum("bh,tbh->tb", d_pooled, s)
        d_e = w * (d_w - (w * d_w).sum(0))
        g["key"] = np.einsum("tb,tba->a", d_e, a)
        d_a = d_e[:, :, None] * p["key"] * (1 - a * a)
        g["att"] = np.einsum("tbh,tba->ha", s, d_a)
        d_s = d_s + d_a @ p["att"].T
        d_gates = {}
        for d, order, at in (("f", range(steps - 1, -1, -1), slice(0, HIDDEN)), ("b", range(steps), slice(HIDDEN, 2 * HIDDEN))):
            u, d_h, d_u = p[f"h{d}"], np.zeros((b, HIDDEN), np.float32), np.zeros_like(p[f"h{d}"])
            d_g = np.zeros((b, steps, 3 * HIDDEN), np.float32)
            for t in order:
                h, z, r, n, sn = trace[d][t]
                m = mask[:, t, None]
                total = d_h + d_s[t, :, at]
                d_new = np.where(m, total, 0)
                d_n = d_new * (1 - z) * (1 - n * n)
                d_z = d_new * (h - n) * z * (1 - z)
                d_r = d_n * sn * r * (1 - r)
                back = np.concatenate([d_z, d_r, d_n * r], 1)
                d_g[:, t] = np.concatenate([d_z, d_r, d_n], 1)
                d_u += h.T @ back
                d_h = d_new * z + back @ u.T + np.where(m, 0, total)
            g[f"h{d}"], g[f"c{d}"] = d_u, d_g.sum((0, 1))
            d_gates[d] = d_g.reshape(b * steps, -1)
            g[f"x{d}"] = flat.T @ d_gates[d]
        d_x = (d_gates["f"] @ p["xf"].T + d_gates["b"] @ p["xb"].T).reshape(b, steps, -1)
        g["word"], g["tri"] = np.zeros_like(p["word"]), np.zeros_like(p["tri"])
        np.add.at(g["word"], word_ids.ravel(), d_x[:, :, :EMBED].reshape(-1, EMBED))
        g["word"][0] = 0
        held = np.nonzero(tri_share)
        part = tri_share[held][:, None] * d_x[held[0], held[1], EMBED:]
        for j in range(EMBED):
            g["tri"][:, j] = np.bincount(tri_ids[held], part[:, j], TRIGRAMS)
        return loss, g


def fit(rows: list[tuple[str, int]], passes: int = 5, steps: int = 240, seed: int = 7, max_words: int = MAX_WORDS, rate: float = 0.01, batch: int = 512) -> Network:
    """A network from (text, label) rows. Passes go on until there were ``steps`` steps, so few rows are gone through more often."""
    rng = np.random.default_rng(seed)
    labels = np.array([y for _, y in rows], np.float32)
    if not len(rows) or labels.min() == labels.max():
        net = Network({}, seed)
        net.constant = float(labels.mean()) if len(rows) else 0.0
        return net
    number: dict[str, int] = {"": 0}
    texts = [np.array([number.setdefault(normal(w), len(number)) for w in tokens(t)], np.int64) for t, _ in rows]
    vocabulary = list(number)
    grams, sizes = trigrams(vocabulary)
    starts = np.cumsum(sizes) - sizes
    df, toxic = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    tri_df, tri_toxic = np.zeros(TRIGRAMS, np.int64), np.zeros(TRIGRAMS, np.int64)
    for own, y, first_seen in zip(texts, labels, originals([t for t, _ in rows]), strict=True):
        if first_seen:  # copies of one text prove nothing about its words
            kinds = np.unique(own)
            df[kinds] += 1
            toxic[kinds] += int(y)
            held = np.zeros(TRIGRAMS, bool)
            held[grams[np.repeat(starts[kinds], sizes[kinds]) + np.arange(sizes[kinds].sum()) - np.repeat(np.cumsum(sizes[kinds]) - sizes[kinds], sizes[kinds])]] = True
            tri_df += held
            tri_toxic += held & bool(y)
    n, n1 = len(rows), float(labels.sum())
    tests = np.flatnonzero(df >= 3)
    least = np.log10(max(1, len(tests))) + 1.3
    telling = {int(i): v for i in tests if toxic[i] >= 3 and (v := significance(int(toxic[i]), int(df[i]), n1 / n)) >= least}
    # Own embeddings go to words that favour toxic texts beyond chance, and to common ones; rare words would only be learned by heart.
    kept = [vocabulary[i] for i in sorted({int(i) for i in tests if df[i] >= max(20, 0.02 * n)} | telling.keys(), key=lambda i: (-df[i], vocabulary[i]))][:max_words]
    net = Network({w: i + 1 for i, w in enumerate(kept)}, seed)
    for i, v in telling.items():
        if vocabulary[i] in net.words:
            net.p["word"][net.words[vocabulary[i]], 0] = min(v, 16.0) / 4
    width = int(sizes.max())
    tests = np.flatnonzero(tri_df >= 3)
    strong = np.log10(max(1, len(tests))) + 1.3
    for i in tests:
        if tri_toxic[i] >= 3 and (v := significance(int(tri_toxic[i]), int(tri_df[i]), n1 / n)) >= strong:
            net.p["tri"][i, 0] = min(v, 16.0)
    tri_ids = np.zeros((len(vocabulary), width), np.int64)
    tri_share = np.zeros((len(vocabulary), width), np.float32)
    for j in range(width):
        has = sizes > j
        tri_ids[has, j] = grams[starts[has] + j]
        tri_share[has, j] = 1 / sizes[has]
    word_ids = np.array([net.words.get(w, 0) for w in vocabulary])
    index, mask, owner = windows(texts, 0)
    telling_tri = np.add.reduceat(net.p["tri"][grams, 0], starts) / sizes
    first = (net.p["word"][word_ids, 0] + telling_tri)[index].max(1)
    scores, moments, step = first, {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}, 0
    y = labels[owner]
    each = spans(owner, len(rows))
    # A part of the rows, with both labels in it, tells when to stop and calibrates the score.
    apart = np.zeros(len(rows), bool)
    for value in (0, 1):
        own = np.flatnonzero(labels == value)
        apart[rng.permutation(own)[: len(own) // 5 if len(own) >= 10 else 0]] = True
    judged = apart if apart.any() and labels[apart].min() != labels[apart].max() else np.ones(len(rows), bool)
    best_loss, best, turn = np.inf, (net.p, 1.0, 0.0), 0
    while turn < passes or (step < steps and turn < 4 * passes):
        turn += 1
        top = np.array([lo + int(np.argmax(scores[lo:hi])) for lo, hi in each])
        others = np.flatnonzero((y == 0) & ~apart[owner] & (rng.random(len(y)) < 2 * len(rows) / max(1, len(y))))
        chosen = np.concatenate([top[~apart], others])
        weight = np.where(y[chosen] > 0, max(1.0, 0.25 * (len(chosen) - n1) / n1), 1).astype(np.float32)
        order = rng.permutation(len(chosen))
        for i in range(0, len(order), batch):
            at = order[i : i + batch]
            k = index[chosen[at]]
            _, g = net.gradients(word_ids[k], tri_ids[k], tri_share[k], mask[chosen[at]], y[chosen[at]], weight[at])
            step += 1
            for name, grad in g.items():
                m, v = moments[name]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                net.p[name] -= rate * ((m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) + (0.005 if name == "tri" else 0.001) * net.p[name])
        scores = net.logits(net.all_gates(vocabulary), index, mask)
        high = np.array([scores[lo:hi].max() for lo, hi in each])[judged]
        scale, shift = logistic(high, labels[judged])
        p = np.clip(sigmoid(scale * high + shift), 1e-6, 1 - 1e-6)
        loss = -float(np.mean(labels[judged] * np.log(p) + (1 - labels[judged]) * np.log(1 - p)))
        if loss < best_loss:
            best_loss, best = loss, ({k: v.copy() for k, v in net.p.items()}, scale, shift)
    net.p, net.scale, net.shift = best
    return net


def originals(texts: list[str]) -> list[bool]:
    """Whether a text is the first of its near copies: none before it has the same least shingle by either of two hashes."""
    seen: set[int] = set()
    out = []
    for i in range(0, len(texts), 256):
        owner, s, _ = shingles(texts[i : i + 256])
        least = []
        for h in (s, mix(s)):
            low = np.full(len(texts[i : i + 256]), np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(low, owner, h)
            least.append(low)
        for one, two in zip(*(x.tolist() for x in least), strict=True):
            out.append(one not in seen and two not in seen)
            seen.update((one, two))
    return out


def significance(hits: int, n: int, share: float) -> float:
    """-log10 of the chance of at least ``hits`` of ``n`` at the given share; 0 if that is no more than expected."""
    if hits < 3 or hits <= n * share:
        return 0.0
    terms = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log(1 - share) for k in range(hits, min(n, hits + 60) + 1)]
    top = max(terms)
    return max(0.0, -(top + math.log(sum(math.exp(t - top) for t in terms))) / math.log(10))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic regression of one variable, lightly held to slope 1."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * x + b)
        w, e = np.maximum(p * (1 - p), 1e-6), p - y
        hess = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        grad = np.array([(e * x).sum() + (a - 1), e.sum()])
        change = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - change[0], b - change[1]
    return float(max(a, 0.05)), float(b)


def spans(owner: np.ndarray, n: int) -> list[tuple[int, int]]:
    ends = np.cumsum(np.bincount(owner, minlength=n))
    return list(zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True))


def windows(texts: list[np.ndarray], padding: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts: indices, mask of real words (the first always counts) and the text of each."""
    lengths = np.array([len(t) for t in texts])
    counts = np.maximum(1, -(-(lengths - WINDOW) // STEP) + 1)
    owner = np.repeat(np.arange(len(texts)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    offsets = np.cumsum(lengths) - lengths
    place = within[:, None] * STEP + np.arange(WINDOW)
    mask = place < lengths[owner][:, None]
    flat = np.concatenate([*texts, np.array([padding], np.int64)])
    index = np.where(mask, flat[np.minimum(offsets[owner][:, None] + place, len(flat) - 1)], padding)
    mask[:, 0] = True
    return index, mask, owner


class Scorer:
    """Scores texts with gate inputs kept for each distinct word."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {"": 0}
        first = self.net.gates(self.net.inputs([""]))
        self.table = {d: np.zeros((4096, 3 * HIDDEN), np.float32) for d in "fb"}
        for d in "fb":
            self.table[d][0] = first[d][0]

    def learn(self, words: set[str]) -> None:
        if len(self.at) > CACHE:
            self.clear()
        new = list(words - self.at.keys())
        if not new:
            return
        start = len(self.at)
        if (need := start + len(new)) > len(self.table["f"]):
            for d in "fb":
                self.table[d] = np.concatenate([self.table[d], np.zeros((need, 3 * HIDDEN), np.float32)])
        for i in range(0, len(new), 20_000):
            part = self.net.gates(self.net.inputs([normal(w) for w in new[i : i + 20_000]]))
            for d in "fb":
                self.table[d][start + i : start + i + len(part[d])] = part[d]
        self.at.update(zip(new, range(start, need), strict=True))

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.net.constant is not None:
            return np.full(len(texts), self.net.constant)
        split = [tokens(t) for t in texts]
        self.learn(set().union(*split))
        get = self.at.__getitem__
        index, mask, owner = windows([np.fromiter(map(get, ws), np.int64, len(ws)) for ws in split], 0)
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, owner, self.net.logits(self.table, index, mask))
        return sigmoid(self.net.scale * top + self.net.shift)


def sampled(docs: DataFrame, labels: DataFrame, label: str, where: Column, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """text and y of at most ``rows`` labelled rows, as long as their texts have ``chars`` characters together, in one partition and always in the same order. Several labels of one id count as the highest."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    known = known.where(where).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    d = ids_and_texts(docs).join(F.broadcast(known), "doc_id")  # ``rows`` ids at most
    d = d.join(F.broadcast(bounded_ids(d.select("doc_id", F.xxhash64("doc_id").alias("h"), F.char_length("text").alias("size")), rows, chars)), "doc_id", "left_semi")
    return d.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows).select("text", "y")


def training_sample(docs: DataFrame, labels: DataFrame, label: str, where: Column, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """The rows of ``sampled`` as a list."""
    return [(r["text"], r["y"]) for r in sampled(docs, labels, label, where, rows, chars).collect()]


def trained(docs: DataFrame, labels: DataFrame, label: str, where: Column, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Network:
    """The network that ``fit`` makes of the training sample, fitted in one task: no text and nothing of the fitting comes to the driver, only the network."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_release()
        net = fit([(text, y) for batch in batches for text, y in zip(*(c.to_pylist() for c in batch.columns), strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])

    found = sampled(docs, labels, label, where, rows, chars).mapInArrow(run, "net binary").collect()
    return pickle.loads(found[0]["net"]) if found else fit([])  # a table known to be empty may have no task


def score(docs: DataFrame, net: Network, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(net)  # bounded by max_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_object(("toxicity", id(sent.value)), lambda: Scorer(sent.value))
        for part, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer.scores(texts).astype(np.float64), pa.float64())], ["doc_id", "score"])

    return ids_and_texts(docs, id_column, text_column).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, net: Network, threshold: float = 0.5, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is under ``threshold``, with all their columns, whatever these are called."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(net)
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_object(("toxicity", id(sent.value)), lambda: Scorer(sent.value))
        for part, texts in chunks(batches, at):
            yield part.filter(pa.array(scorer.scores(texts) < threshold))

    return map_rows(docs, run)
