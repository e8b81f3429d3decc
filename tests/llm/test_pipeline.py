"""The pipeline's stages over a whole table: near duplicates, PII and BPE against plain loops over the stage's input, the others by what they keep."""

import duckdb
import pytest
import tokenizers
from test_contracts import plain_disclosures
from test_near_dup_exact import all_pairs, components, sets_of

import corpus_pipeline
from gaugeflow.llm import bpe, neardup, pii, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").persist()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
        docs.count()
        out.append(docs)
    return out


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dup", "pii", "mixing", "bpe"]
    assert all(d.columns == steps[0].columns for d in steps[1:5])


def test_each_stage_takes_effect(steps):
    docs, clean, unique, private, mixed, tokens = (d.collect() for d in steps)
    assert {r["doc_id"] for r in unique} <= {r["doc_id"] for r in clean} <= {r["doc_id"] for r in docs}
    assert 0 < len(unique) < len(clean) < len(docs)
    assert len({r["text"] for r in unique}) == len(unique)
    texts = {r["doc_id"]: r["text"] for r in unique}
    for r in private:
        assert not pii.base_spans(r["text"]) or "[" in r["text"]
        if not pii.base_spans(texts[r["doc_id"]]):
            assert r["text"] == texts[r["doc_id"]]
    assert sorted(map(str, mixed)) == sorted(map(str, private))
    kept = {r["doc_id"]: r["text"] for r in mixed}
    assert {r["doc_id"]: r["decoded"] for r in tokens} == kept


def test_near_duplicates_stage_against_all_pairs(spark, steps):
    rows = sorted((r["doc_id"], r["text"] or "") for r in steps[1].select("doc_id", "text").collect())
    nodes = {}
    for i, t in rows:
        nodes.setdefault(t, i)  # the least id of equal texts
    shares, _ = neardup.document_frequencies(steps[1].select("doc_id", "text"))
    label = components(len(nodes), all_pairs(sets_of(list(nodes), shares)))
    best = {}
    for c, i in zip(label, nodes.values(), strict=True):
        best[c] = min(i, best.get(c, i))
    assert sorted(best.values()) == sorted(r["doc_id"] for r in steps[2].collect())


def test_pii_stage_against_the_definition(spark, steps):
    policy = pii.Policy()
    before = {r["doc_id"]: r["text"] or "" for r in steps[2].select("doc_id", "text").collect()}
    flagged = {k: v for k, v in plain_disclosures(list(before.values()), policy).items() if v >= policy.generalise}
    for r in steps[3].select("doc_id", "text").collect():
        text = before[r["doc_id"]]
        own = {pii.entity(text, s) for s in pii.base_spans(text)}
        hits = {}
        for (c, term), v in flagged.items():
            if c in own:
                hits[term] = max(hits.get(term, ""), "remove" if v >= policy.remove else "generalise")
        assert (r["text"] or "") == pii.cleaned(text, hits)


def test_bpe_stage_against_the_library(steps):
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    library.no_truncation()
    library.no_padding()
    texts = {r["doc_id"]: r["text"] or "" for r in steps[4].select("doc_id", "text").collect()}
    rows = steps[5].select("doc_id", "ids").collect()
    assert len(rows) == len(texts)
    for r in rows[::3]:
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_registered_queries(spark):
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()
    con = duckdb.connect()
    for t in ("conversations", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in queries.ORACLES.items():
        found = queries.QUERIES[name](spark, SF)
        cursor = con.execute(sql)
        columns = [c[0] for c in cursor.description]
        assert sorted(map(str, ([r[c] for c in columns] for r in found.collect()))) == sorted(str(list(r)) for r in cursor.fetchall())
