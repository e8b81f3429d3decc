"""Defined results for inputs that once broke the operators, and plain predictors beside the fast ones."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugeflow.llm import chat, langid, mixing, neardup, pii, quality, topk, toxicity

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(columns=("doc_id", "text", "lang")):
    t = pq.read_table(f"{SF}/documents.parquet", columns=list(columns))
    return list(zip(*(t[c].to_pylist() for c in columns), strict=True))


# 1 PII


def test_long_digit_runs():
    zeros = "0" * 5000
    assert pii.base_spans("x 1.2.3." + zeros) == [(2, 1, 8 + len(zeros))]
    assert pii.base_spans("1.2.3." + "9" * 5000) == []
    assert [k for _, k, _ in pii.base_spans(f"{zeros}1.2.3.4")] == [1]


def test_windows_hold_whole_terms():
    long = "l" * 350
    text = f"far {long} w1 w2 w3 w4 w5 w6 w7 a@b.cd w8 {long}x end"
    (_, near), = pii.windows(text, pii.base_spans(text))
    assert near == [long, *[f"w{i}" for i in range(1, 8)], "w8", f"{long}x", "end"]
    two = "one a@b.cd two 1.2.3.4 three"
    assert [n for _, n in pii.windows(two, pii.base_spans(two))] == [["one", "two", "three"]] * 2


def plain_disclosures(texts, policy):
    """(entity, term) -> disclosure of the pairs with enough different windows, by the definition."""
    n = len(texts)
    holds = [set(pii.TERM.findall(t.lower())) for t in texts]
    seen = []
    for t in texts:
        own = {}
        for c, near in pii.windows(t, pii.base_spans(t)):
            own.setdefault(c, []).append(tuple(near))
        seen.append(own)
    out = {}
    for c in {c for own in seen for c in own}:
        n_c = sum(c in own for own in seen)
        for term in {x for own in seen for w in own.get(c, []) for x in w}:
            if len({w for own in seen for w in own.get(c, []) if term in w}) < policy.support or n_c == n:
                continue
            n_ct = sum(any(term in w for w in own.get(c, [])) for own in seen)
            n_t = sum(term in h for h in holds)
            out[c, term] = math.log(n * n_ct / (n_c * n_t)) / math.log(n / n_c)
    return out


def test_added_spans_equal_the_definition(spark):
    rng = random.Random(5)
    names, words = ["falke", "orion", "delta9", "kestrel"], [f"w{i}" for i in range(40)]
    texts = []
    for i in range(160):
        ws = [rng.choice(words) for _ in range(rng.randint(4, 30))]
        if i % 3 == 0:
            j = rng.randrange(4)
            at = rng.randrange(len(ws))
            ws[at:at] = [names[j] if rng.random() < 0.8 else rng.choice(words), f"user{j}@corp.example"]
        if rng.random() < 0.05:
            ws.append(rng.choice(names))
        texts += [" ".join(ws)] * (1 if i % 10 else 7)
    policy = pii.Policy()
    flagged = {k: v for k, v in plain_disclosures(texts, policy).items() if v >= policy.generalise}
    assert flagged
    found = {r["doc_id"]: r["spans"] for r in pii.annotate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), policy).collect()}
    for i, t in enumerate(texts):
        base = pii.base_spans(t)
        terms = {}
        for c in {pii.entity(t, s) for s in base}:
            for (c2, term), v in flagged.items():
                if c2 == c:
                    terms[term] = max(terms.get(term, ""), "remove" if v >= policy.remove else "generalise")
        want = sorted([(a, b, pii.KINDS[k]) for a, k, b in base] + [(m.start(), m.end(), terms[m[0].lower()]) for m in pii.TERM.finditer(t) if m[0].lower() in terms and not any(a < m.end() and m.start() < b for a, _, b in base)])
        assert [(s["start"], s["end"], s["kind"]) for s in found[i]] == want


def test_copies_do_not_hide_a_disclosure(spark):
    filler = ["alpha beta gamma delta", "one two three four five", "red green blue", "north south east west"]
    rows = [f"{filler[i]} number {i} falkenhorst wrote from boss@corp.example about {i * 7}" for i in range(4)]
    others = [f"{filler[i % 4]} number {i} somebody wrote from home about it" for i in range(200)]
    for times in (1, 10):
        d = spark.createDataFrame(list(enumerate(rows * times + others)), "doc_id long, text string")
        found = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.annotate(d).collect()}
        assert found[0] == ["remove", "email"]


# 2 chat


def test_loss_spans_cut_the_trained_texts_out(spark):
    rows = [(1, None, "assistant", "b<|end|>"), (1, 1, "user", "ü\n"), (1, 1, "assistant", "😀x"), (1, 2, "assistant", None), (2, 0, "user", "a"), (1, None, "assistant", "b<|end|>")]
    d = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in d.collect():
        own = [s["text"] for s in r["segments"] if s["loss"]]
        assert [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]] == own
    assert {r["conv_id"]: r["loss_chars"] for r in chat.digests(d).collect()} == {1: 8 + 8 + 2, 2: 0}


# 3 language


def plain_language(model, text):
    """The definition, word by word and place by place."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    words = letters.split()
    if not words:
        return "und", 0.0
    total = list(model.prior)
    for w in words:
        if w in model.words:
            total = [a + b for a, b in zip(total, model.words[w], strict=True)]
            continue
        marked = f" {w} "
        for end in range(2, len(marked) + 1):
            row = next((model.grams[g] for n in range(min(model.order, end), 0, -1) if (g := marked[end - n : end]) in model.grams), (-math.log(1e6),) * len(model.languages))
            total = [a + b for a, b in zip(total, row, strict=True)]
    total = [x / len(words) for x in total]
    best = max(range(len(total)), key=lambda i: (total[i], -i))
    return model.languages[best], 1 / sum(math.exp(x - total[best]) for x in total)


def test_language_equals_the_definition(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(langid.training_sample(docs, F.col("doc_id") % 4 != 2, rows=200))
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    for i, text, _ in rows_of()[::5]:
        lang, score = plain_language(model, text or "")
        assert found[i][0] == lang and found[i][1] == pytest.approx(score, rel=1e-6)


def test_letterless_texts_are_und(spark):
    model = langid.fit([("en", "some words"), ("de", "ein paar Worte")])
    texts = ["²½", "①②", "Ⅷ 12", "_", "", None, "é", "漢"]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [got[i] == "und" for i in range(8)] == [True] * 6 + [False] * 2
    assert langid.predict(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
    many = spark.createDataFrame([(i, "a" * 100, "en") for i in range(50)], "doc_id long, text string, lang string")
    assert len(langid.training_sample(many, F.lit(True), rows=30)) == 30 and len(langid.training_sample(many, F.lit(True), rows=30, chars=1000)) == 10


# 4 search


def test_huge_components_have_a_defined_score(spark):
    rows = [(0, [1e300, 0.0]), (1, [1e300, 1.0]), (2, [-1e300, 0.0]), (3, [1.0, 5.0]), (4, [2.0**60, 3.0]), (5, [1.5, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(d, F.lit(True), k=5, scale=1).orderBy("query_id", "rank").collect()]
    long = 2**63 - 1
    whole = {i: [max(-(2**63), min(long, math.floor(x))) for x in v] for i, v in rows}
    most = 2**62 - 1
    want = []
    for q in whole:
        scores = sorted((-max(-most, min(most, sum(a * b for a, b in zip(whole[q], whole[c], strict=True)))), c) for c in whole if c != q)
        want += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scores)]
    assert got == want


# 5 mixing


def test_mix_keeps_columns_of_any_name(spark):
    d = spark.createDataFrame([(i, "ab"[i % 2], i * 10, i * 100, "x", 5) for i in range(40)], "doc_id long, source string, __source int, mix_slot int, `a.b` string, __places int")
    out = mixing.mix(d)
    assert out.columns == [*d.columns, "mix_slot_", "mix_place"]
    assert sorted(tuple(r)[:6] for r in out.collect()) == sorted(map(tuple, d.collect()))
    assert mixing.ordered(d).columns == d.columns and mixing.ordered(d).count() == 40


# 6 toxicity


def test_toxicity_equals_one_window_at_a_time():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["x" * 130, "Filth!"]
    rows = [(" ".join([rng.choice(words) for _ in range(rng.choice([3, 40]))] + (["scum"] if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(120)]
    net = toxicity.fit(rows, steps=20)
    texts = [t for t, _ in rows[:25]] + ["", "y" * 500, " ".join(["long"] * 300)]
    fast = toxicity.Scorer(net).scores(texts)
    for text, score in zip(texts, fast, strict=True):
        tokens = [w[i : i + toxicity.LONGEST] for w in text.split() for i in range(0, len(w), toxicity.LONGEST)]
        best = -np.inf
        for start in range(0, max(1, len(tokens) - toxicity.WINDOW + toxicity.STEP), toxicity.STEP):
            window = [toxicity.normal(w) for w in tokens[start : start + toxicity.WINDOW]] or [""]
            gates = net.gates(np.concatenate([net.inputs([w]) for w in window]))
            n = len(window)
            state, _ = net.states(gates, np.arange(n)[None], np.ones((1, n), bool))
            best = max(best, float(net.pool(state, np.ones((1, n), bool))[0][0]))
        assert score == pytest.approx(float(toxicity.sigmoid(net.scale * best + net.shift)), abs=1e-4)


def test_toxicity_empty_table_and_bounded_sample(spark):
    net = toxicity.fit([("good words", 0), ("bad words", 1)] * 6)
    empty = spark.createDataFrame([], DOCS)
    assert toxicity.score(empty, net).count() == 0 and toxicity.keep(empty, net).count() == 0
    docs = spark.createDataFrame([(i, "a" * 100) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    assert len(toxicity.training_sample(docs, labels, "toxic", F.lit(True), rows=40)) == 40
    assert len(toxicity.training_sample(docs, labels, "toxic", F.lit(True), rows=40, chars=1000)) == 10
    assert toxicity.training_sample(docs.limit(0), labels, "toxic", F.lit(True)) == []


# 7 quality


def test_quality_equals_row_by_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(*quality.training_sample(docs, labels, "quality", F.col("doc_id") % 5 != 0))
    found = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    for i, text, _ in rows_of()[::4]:
        x = quality.features(text or "")
        total = model.constant
        for v, cuts, table in zip(x, model.cuts, model.tables, strict=True):
            total += table[sum(c <= v for c in cuts)]
        for a, b, table in model.pairs:
            total += table[sum(c <= x[a] for c in model.pair_cuts[a]), sum(c <= x[b] for c in model.pair_cuts[b])]
        assert found[i] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-6, abs=1e-9)
    assert quality.score(docs.limit(0), model).count() == 0
    long = spark.createDataFrame([(1, "word " * 400_000), (2, None)], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in quality.score(long, model).collect())


# 8 near duplicates


def test_near_duplicates_of_long_texts(spark):
    base = [f"v{i % 7919}" for i in range(30_000)]
    other = list(base)
    other[100] = "x"
    rows = [(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(base[::-1])), (4, "z" * 500_000)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


# pipeline


def test_pipeline_stages_take_odd_rows_and_any_column(spark, tmp_path):
    texts = [None, "", " \n", "word", "mail a@b.cd now", "x" * 2000, "same text here", "same text here", "long " * 3000, "²½ 中文 😀", "1.2.3." + "0" * 5000]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 2}" if i % 3 else None, 0) for i, t in enumerate(texts)] + [(None, "no id", None, "s1", 0), (3, "word", "en", "s0", 0)]
    odd = spark.createDataFrame(rows, DOCS).withColumns({"a.b": F.lit("dot"), "mix_slot": F.lit(-7), "__source": F.lit("clash"), "band": F.lit(1), "key": F.lit(2)})
    for docs in (odd, odd.limit(0)):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            # written and read again between the stages, as the pipeline does
            path = f"{tmp_path}/{name}-{docs.count()}-{i}"
            out = stage(spark, docs, SF)
            out.write.parquet(path)
            back = spark.read.parquet(path)
            if i < 4:
                assert back.columns == odd.columns
                assert {(r["a.b"], r["mix_slot"], r["__source"]) for r in back.collect()} <= {("dot", -7, "clash")}
            assert back.count() <= docs.count() and (docs.count() > 0 or back.count() == 0)
            docs = back


def test_mix_survives_to_the_end_of_the_pipeline(spark):
    out = corpus_pipeline.run(spark, SF).select("doc_id", "mix_file", "mix_row").persist()
    assert {"mix_file", "mix_row"} <= {*out.columns}
    source = {i: s for i, _, s in rows_of(("doc_id", "text", "source"))}
    order = [source[r["doc_id"]] for r in out.orderBy("mix_file", "mix_row").collect()]
    counts = Counter(order)
    period = mixing.schedule(mixing.target_shares(spark.createDataFrame([(s,) for s in order], "source string")))
    shares = Counter(s for s, _, _ in period)
    # until the first source ends, every prefix of whole blocks holds each source's weight to less than one block (plus the block that is cut)
    left = dict(counts)
    for n, s in enumerate(order, 1):
        left[s] -= 1
        if min(left.values()) == 0:
            break
        if n % 160 == 0:
            have = Counter(order[:n])
            assert all(abs(have[x] - n * shares[x] / len(period)) < 2 * mixing.BLOCK_ROWS for x in shares)
    assert n > 100
    assert out.select("mix_file", "mix_row").distinct().count() == len(order)
