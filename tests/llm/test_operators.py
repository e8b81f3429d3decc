"""The ten operators against brute force, exact round trips or held-out accuracy, and their edge cases."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import bpe, chat, langid, mixing, neardup, pii, quality, queries, rules, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "word", "1234 5678", "x" * 3000, "wörter über alles 中文 😀", "a b c d e f", "a b c d e f", "same " * 50, "\x00\x1c_-_ <|endoftext|> [INST]"]


def odd_docs(spark):
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", 0) for i, t in enumerate(ODD)]
    rows += [(7, ODD[7], "en", "s1", 0), (None, "no id", "en", "s1", 0), (3, "word again", "fr", "s0", 0)]
    return spark.createDataFrame(rows, DOCS).withColumn("__key", F.lit("clash")).withColumn("band", F.lit(1)).withColumn("score", F.lit(2))


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# 1 PII

PATTERNS = [
    (0, re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda t: True),
    (1, re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda t: all(int(p) <= 255 for p in t.split("."))),
    (2, re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda t: 14 <= sum(c.isdigit() for c in t) <= 19 and luhn(t)),
    (3, re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda t: 10 <= sum(c.isdigit() for c in t) <= 15),
]


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def brute_spans(text):
    return sorted((m.start(), kind, m.end()) for kind, p, ok in PATTERNS for m in p.finditer(text) if ok(m[0]))


def test_pii_base_spans_equal_the_patterns():
    rng = random.Random(5)
    for k in range(4000):
        letters = rng.choice(["a@.1 ", "1. -", "+1 ()-.5", "ab@.@-x1", "12 .+@a-0"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        text += " 4111 1111 1111 1111 +1 (555) 123-4567 1.2.3.4 a.b@c.de" if k % 3 == 0 else ""
        assert pii.base_spans(text) == brute_spans(text), text


def test_pii_query_on_whole_table(spark, sf_dir):
    found = {r["doc_id"]: r for r in queries.op1_pii(spark, sf_dir).collect()}
    for r in documents(spark, sf_dir).collect():
        spans = brute_spans(r["text"] or "")
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        got = found[r["doc_id"]]
        assert got["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [got[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in spans) for i in range(4)]
        assert set(base.split(",")) - {""} <= set(got["spans"].split(","))


def test_pii_flags_terms_that_give_an_entity_away(spark):
    filler = ["alpha beta gamma delta", "one two three four five", "red green blue", "north south east west"]
    rows = [(i, f"{filler[i % 4]} number {i} falkenhorst wrote from boss@corp.example about item {i * 7}", "en", "s", 0) for i in range(6)]
    rows += [(100 + i, f"{filler[i % 4]} about number {i} and item {i}", "en", "s", 0) for i in range(200)]
    rows += [(400 + i, rows[0][1].replace("falkenhorst", "copyterm").replace("boss@", "other@"), "en", "s", 0) for i in range(50)]
    d = spark.createDataFrame(rows, DOCS)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(d).collect()}
    assert clean[0] == "alpha beta gamma delta number 0  wrote from [EMAIL] about item 0"  # falkenhorst stands nowhere else
    assert clean[150] == rows[6 + 50][1]
    assert "copyterm" in clean[400] and "[EMAIL]" in clean[400]  # one window, however often it is copied, proves nothing
    spans = {r["doc_id"]: r["spans"] for r in pii.annotate(d).collect()}
    assert [s["kind"] for s in spans[1]] == ["remove", "email"]


def test_pii_odd_rows(spark):
    d = odd_docs(spark)
    out = pii.sanitise(d)
    assert out.columns == d.columns and sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, d.select("doc_id", "text").collect()))
    assert pii.annotate(d).count() == d.count() and pii.annotate(d.limit(0)).count() == 0


# 2 chat


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_round_trip_and_escapes(spark):
    rng = random.Random(1)
    bits = ["<|end|>\n", "<|start|>user\n", "\\", "\\0", "\\1", "<", "[", "[INST]", "</s>", "\n", "x", "ü", "\\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "we<ird\nrole\\", None]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8))) if rng.random() < 0.9 else None) for c in range(60) for t in range(rng.randint(1, 5))]
    d = conversations(spark, rows)
    formatted = chat.format_conversations(d)
    parsed = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.parse(formatted).collect()}
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((role or "", text or ""))
    assert parsed == want
    for r in formatted.collect():
        texts = [s["text"] for s in r["segments"]]
        assert "".join(texts) == r["formatted"]
        assert all(mark not in t for t in texts[1::3] for mark in chat.Template().marks)
        assert [s["loss"] for s in r["segments"][1::3]] == [role == "assistant" for role, _ in want[r["conv_id"]]]


def test_chat_turn_order(spark):
    cases = {1: "user assistant", 2: "system user assistant user", 3: "assistant user", 4: "user user", 5: "system", 6: "user assistant robot"}
    rows = [(c, i, role, "t") for c, roles in cases.items() for i, role in enumerate(roles.split())]
    got = {r["conv_id"]: (r["valid"], r["error_turn"]) for r in chat.format_conversations(conversations(spark, rows)).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 0), 4: (False, 1), 5: (False, 1), 6: (False, 2)}
    assert chat.format_conversations(conversations(spark, [])).count() == 0
    twice = chat.format_conversations(conversations(spark, [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")])).collect()[0]
    assert [s["text"] for s in twice["segments"][1::3]] == ["a", "a", "b"]


# 3 language


def test_language_held_out(spark, sf_dir):
    found = queries.op3_language_id(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r["held_out"] and r["lang"]]
    assert len(found) == documents(spark, sf_dir).count() and len(held) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.9


def test_language_backs_off_and_odd_rows(spark):
    model = langid.fit([("en", "the walking and talking thing"), ("de", "der gehend und sprechend ding")] * 3)
    s = langid.Scorer(model)
    assert s.predict(["the", "zzwalking", "sprechendes", "123 !"])[0] == ["en", "en", "de", "und"]
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in langid.predict(odd_docs(spark), model).collect()}
    assert got[(0, "und")] == 0.0 and got[(1, "und")] == 0.0 and got[(4, "und")] == 0.0 and all(0 <= v <= 1 for v in got.values())
    assert {r["lang_pred"] for r in langid.predict(odd_docs(spark), langid.fit([])).collect()} == {"und"}


# 4 top k


@pytest.mark.parametrize("kind", ["random", "clustered", "equal"])
def test_top_k_equals_brute_force(spark, kind):
    rng = np.random.default_rng(2)
    n = 900
    v = rng.standard_normal((n, 12)) if kind == "random" else np.repeat(rng.standard_normal((9, 12)) * 20, 100, 0) + 0.1 * rng.standard_normal((n, 12)) if kind == "clustered" else np.ones((n, 12))
    rows = [(int(i), [float(x) for x in v[i]]) for i in range(n)] + [(9000, None), (9001, [1.0, float("nan")] + [0.0] * 10), (9100, [None] * 12), (None, [1.0] * 12), (9200, []), (9300, [1.0, 2.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash"))
    got = topk.top_k(d, F.col("vec_id") % 100 == 0, k=10, block_rows=128, chunk_rows=4).collect()
    q = np.floor(1024 * v).astype(np.int64)
    for query in range(0, n, 100):
        want = sorted((-int(q[query] @ q[i]), i) for i in range(n) if i != query)[:10]
        assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == query] == [(j + 1, i, -s) for j, (s, i) in enumerate(want)]
    assert {r["query_id"] for r in got} == set(range(0, n, 100))


def test_top_k_prunes_and_large_values():
    rng = np.random.default_rng(0)
    v = (np.repeat(rng.standard_normal((20, 8)) * 5000, 200, 0) + rng.standard_normal((4000, 8)) * 20).astype(np.int64)
    s = topk.Search(np.arange(40), v[::100], 5)
    s.add(np.arange(4000) + 100, v)
    assert s.met < 40 * 4000 / 2
    big = np.array([[2**30, 1], [2**30, 2], [-(2**30), 3]], np.int64)
    s = topk.Search(np.array([0]), big[:1], 3)
    s.add(np.arange(3), big)
    assert s.results()[2].tolist() == [int(big[0].astype(object) @ big[1].astype(object)), int(big[0].astype(object) @ big[2].astype(object))]


# 5 mixing


def test_schedule_keeps_within_a_block():
    for shares in ({"a": 1}, {"a": 5, "b": 3, "c": 2}, {"a": 97, "b": 2, "c": 1, None: 13}, {f"s{i}": i + 1 for i in range(20)}):
        period = mixing.schedule(shares)
        total = sum(shares.values())
        done = dict.fromkeys(shares, 0)
        for t, (s, j, slot) in enumerate(period, 1):
            assert slot == t - 1 and j == done[s]
            done[s] += 1
            assert all(abs(done[x] - shares[x] * t / total) < 1 for x in shares)


def test_mix_against_brute_force(spark):
    rng = random.Random(0)
    rows = [(i, "t", None, rng.choice(["hot", "hot", "hot", "b", "c", None]), 0) for i in range(700)]
    shares = {"hot": 2, "b": 2, "c": 1, None: 1}
    got = mixing.mix(spark.createDataFrame(rows, DOCS), shares, block_rows=4, bits=3).collect()
    assert len(got) == 700
    period = mixing.schedule(shares)
    h = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)
    for s in shares:
        own = sorted((r[0] for r in rows if r[3] == s), key=lambda i: (h(i), i))
        places = [p[2] for p in period if p[0] == s]
        want = {i: (len(period) * (k // 4 // len(places)) + places[k // 4 % len(places)], k % 4) for k, i in enumerate(own)}
        assert {r["doc_id"]: (r["mix_slot"], r["mix_place"]) for r in got if r["source"] == s} == want


def test_mix_odd_rows(spark):
    d = odd_docs(spark)
    out = mixing.mix(d)
    assert out.count() == d.count() and out.columns[: len(d.columns)] == d.columns and out.where("mix_slot IS NULL").count() == 0
    assert mixing.mix(d, {"s0": 1}).where("mix_slot IS NULL").count() == d.where("source IS NULL OR source <> 's0'").count()
    assert mixing.mix(d.limit(0)).count() == 0


# 6 toxicity


def toy(n, seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        ws = [rng.choice(words) for _ in range(rng.choice([5, 30, 120]))]
        if i % 3 == 0:
            ws[rng.randrange(len(ws))] = rng.choice(["vile", "scum", "Filth!"])
        out.append((" ".join(ws), int(i % 3 == 0)))
    return out


def test_gradients():
    net = toxicity.Network({"a": 1, "b": 2}, 1)
    rng = np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    args = rng.integers(0, 3, (4, 6)), rng.integers(0, 50, (4, 6, 3)), np.full((4, 6, 3), 1 / 3), np.ones((4, 6), bool), np.array([1.0, 0, 1, 0]), np.ones(4)
    args[3][1, 4:] = False
    _, g = net.gradients(*args)
    for name, value in net.p.items():
        at = {"word": (1, 0), "tri": (args[1][0, 0, 0], 0)}.get(name, tuple(0 for _ in value.shape))
        old = value[at]
        value[at] = old + 1e-3
        up = net.gradients(*args)[0]
        value[at] = old - 1e-3
        down = net.gradients(*args)[0]
        value[at] = old
        assert g[name][at] == pytest.approx((up - down) / 2e-3, rel=2e-2, abs=2e-6), name


def test_windows_cover_every_word():
    for n in (0, 1, 23, 24, 25, 36, 37, 100):
        index, mask, owner = toxicity.windows([np.arange(n) + 1, np.array([7])], 0)
        own = owner == 0
        assert set(index[own][mask[own]].tolist()) - {0} == set(range(1, n + 1)) and (owner == 1).sum() == 1


def test_toxicity_learns_and_scores_anywhere_in_a_text(spark):
    net = toxicity.fit(toy(600))
    s = toxicity.Scorer(net)
    test = toy(300, 9)
    assert np.mean((s.scores([t for t, _ in test]) >= 0.5) == [bool(y) for _, y in test]) > 0.95
    filler = " ".join(f"w{i % 300}" for i in range(2000))
    low, high = s.scores([filler, filler + " scum w1"])
    assert low < 0.5 < high
    d = odd_docs(spark)
    assert toxicity.score(d, net).count() == d.count() and toxicity.keep(d, net).columns == d.columns
    assert [r["score"] for r in toxicity.score(d, toxicity.fit([])).select("score").distinct().collect()] == [0.0]
    assert toxicity.fit([("a", 1)]).constant == 1.0


def test_toxicity_held_out(spark):
    found = queries.op6_toxicity(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    held = found.join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.9
    assert found.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


# 7 quality


def test_quality_held_out(spark):
    found = queries.op7_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    held = found.join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.9


def test_quality_pairs_catch_what_features_alone_cannot(spark):
    x = np.random.default_rng(0).random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:2000], y[:2000], rounds=30)
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    assert {(a, b) for a, b, _ in model.pairs[:1]} == {(1, 0)}
    one = model.constant + sum(t[np.searchsorted(c, x[:1, j], side="right")] for j, (c, t) in enumerate(zip(model.cuts, model.tables, strict=True)))
    one = one + sum(t[np.searchsorted(model.pair_cuts[a], x[0, a], side="right"), np.searchsorted(model.pair_cuts[b], x[0, b], side="right")] for a, b, t in model.pairs)
    assert model.raw(x[:1])[0] == pytest.approx(one[0])
    d = odd_docs(spark)
    assert quality.score(d, quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))).where("score > 0.01").count() == 0


# 8 near duplicates


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    base = [[f"v{rng.randrange(4000)}" for _ in range(rng.randint(60, 200))] for _ in range(25)]
    texts = []
    for b in base:
        for _ in range(rng.randint(1, 8)):
            w = list(b)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 12])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9999)}"
            texts.append(" ".join(w))
    d = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(d).collect()}
    shares, _ = neardup.document_frequencies(d.select("doc_id", "text"))
    owner, hashes, tf = neardup.shingles(texts)
    weight = neardup.weights(hashes, tf, shares)
    sets = [dict(zip(hashes[owner == i].tolist(), weight[owner == i].tolist(), strict=True)) for i in range(len(texts))]
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        common = sum(min(w, sets[j].get(h, 0.0)) for h, w in sets[i].items())
        if common / (sum(sets[i].values()) + sum(sets[j].values()) - common) >= 0.8 and label[i] != label[j]:
            lo, hi = sorted((label[i], label[j]))
            label = [lo if x == hi else x for x in label]
    assert got == dict(enumerate(label))
    assert sorted(r["doc_id"] for r in neardup.dedup(d).collect()) == sorted(set(label))


def test_weighted_jaccard_and_samples():
    text = " ".join(f"w{i}" for i in range(300))
    other = " ".join(f"w{i}" if i % 40 else "x" for i in range(300))
    shares = np.full(2 * neardup.SKETCH, -1, np.float32)
    bins, some = neardup.samples([text, other, "", "one two"], shares)
    owner, s, tf = neardup.shingles([text, other])
    a, b = set(s[owner == 0].tolist()), set(s[owner == 1].tolist())
    assert abs((bins[0] == bins[1]).mean() - len(a & b) / len(a | b)) < 0.2 and list(some) == [True, True, False, True]
    one = np.array([1, 2, 3], np.uint64), np.array([1.0, 2.0, 1.0])
    two = np.array([2, 3, 9], np.uint64), np.array([1.0, 1.0, 1.0])
    assert neardup.jaccard(*one, *two) == pytest.approx(2 / 5)


def test_document_frequencies_find_common_shingles(spark):
    rows = [(i, f"common words that everyone repeats here then {i} own{i} text{i} goes{i} on{i}", None, None, 0) for i in range(400)]
    shares, n = neardup.document_frequencies(spark.createDataFrame(rows, DOCS).select("doc_id", "text"))
    _, s, tf = neardup.shingles(["common words that everyone repeats", "own1 text1 goes1 on1 zzz"])
    w = neardup.weights(s, tf, shares)
    assert n == 400 and sorted(w.tolist())[0] == pytest.approx(neardup.FLOOR) and max(w) == 1.0


def test_near_duplicates_odd_rows(spark):
    d = odd_docs(spark)
    rows = {(r["doc_id"], r["class_id"]) for r in neardup.classes(d).collect()}
    assert (0, 0) in rows and (1, 0) in rows and (8, 7) in rows and (7, 7) in rows
    kept = neardup.dedup(d)
    assert kept.columns == d.columns and sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.select("doc_id").collect()) == sorted((i is None, i or 0) for i in [0, 2, 3, 3, 4, 5, 6, 7, 9, 10, None])
    assert neardup.classes(d.limit(0)).count() == 0 and neardup.dedup(d.limit(0)).count() == 0


# 9 quality rules


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for places in seen.values() if len(places) > 1 for i in places for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def divergence(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    part = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)
    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


def test_rules_on_whole_table(spark, sf_dir):
    docs = documents(spark, sf_dir)
    limits, refs = rules.Rules(), rules.learn(docs)
    got = {r["doc_id"]: r for r in rules.score(docs, refs).collect()}
    totals, tops = {}, {}
    for r in docs.collect():
        for w in re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").lower()):
            tops.setdefault(r["lang"], {}).setdefault(w, 0)
            tops[r["lang"]][w] += 1
            totals[r["lang"]] = totals.get(r["lang"], 0) + 1
    for lang, counts in tops.items():
        best = sorted(counts, key=lambda w: (-counts[w], w.encode()))[: limits.common]
        assert refs.words[lang] == sorted(best) and refs.shares[lang][:-1] == pytest.approx([counts[w] / totals[lang] for w in sorted(best)])
    for r in docs.collect():
        text = r["text"] or ""
        want = brute_rules(text)
        g = got[r["doc_id"]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"]) == want
        n = want[0]
        lowered = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        size = len(text)
        capitals = [chr(c) for c in (*range(0xC0, 0xD7), *range(0xD8, 0xDF))]
        letters = ("abcdefghijklmnopqrstuvwxyz", " \t\n\v\f\r", ["A", *"BCDEFGHIJKLMNOPQRSTUVWXYZ", *capitals], "0123456789", ".,;:!?'\"()-", "#*$%&|<>")
        counts = [sum(c in own for c in text) for own in letters]
        counts.append(size - sum(counts))
        assert counts[:2] == [sum(c in letters[0] for c in text), size - want[1]]
        ok = False
        for lang in refs.classes:
            by_class = 0.0 if len(text) < limits.min_chars else divergence([c / size for c in counts], refs.classes[lang])
            hist = [lowered.count(w) / max(1, n) for w in refs.words[lang]]
            by_word = 0.0 if n < limits.min_words else divergence([*hist, 1 - sum(hist)], refs.shares[lang])
            ok |= by_class <= limits.class_limit and by_word <= limits.word_limit
        assert g["kept"] == (ok and not want[5])


def test_rules_odd_rows(spark):
    d = odd_docs(spark)
    refs = rules.learn(d)
    got = rules.score(d, refs).collect()
    assert len(got) == d.count() and {r["doc_id"]: r["n_repeat_words"] for r in got}[9] == 50
    assert all(r["kept"] == (not r["base_failed"]) for r in rules.score(d, rules.References()).collect())
    assert rules.learn(d.limit(0)).classes == {} and rules.score(d.limit(0), refs).count() == 0


# 10 BPE


def test_bpe_equals_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(bpe.default_path())
    texts = {r["doc_id"]: r["text"] or "" for r in documents(spark, sf_dir).collect()}
    got = {r["doc_id"]: r for r in queries.op10_bpe(spark, sf_dir).collect()}
    for i, text in texts.items():
        ids = reference.encode(text, add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_texts_and_small_trie(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(bpe.default_path())
    rng = random.Random(0)
    texts = [t or "" for t in ODD] + ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "don't we'll 'S 's", "²³ ٣ ½ x_y __", "a b　c\x85d", "\r\n \t\n  x"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 700), rng.randrange(0x4E00, 0x9000), rng.randrange(0x1F300, 0x1F600)])) for _ in range(60)) for _ in range(200)]
    encoder = bpe.TrieEncoder(bpe.Vocabulary(bpe.read_vocabulary(bpe.default_path())), nodes=300)
    for text in texts:
        packed = encoder.encode([text])[0]
        assert np.frombuffer(packed, "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids, repr(text)
        assert encoder.decode(packed) == text
    for word in ("hello", "antidisestablishmentarianism", "aaaaaaa"):
        assert b"".join(encoder.pack[t] for t in encoder.v.merge(word.encode())) == encoder.insert(word.encode())
    d = odd_docs(spark)
    out = bpe.encode(d)
    assert out.count() == d.count() and bpe.decode(out.select("doc_id", "ids")).join(out.select("doc_id", F.col("decoded").alias("want"), "ids"), ["doc_id", "ids"]).where("decoded <> want").count() == 0
    assert bpe.encode(d.limit(0)).count() == 0
