"""A disclosing term goes wherever it stands in a text that holds its entity."""

from gaugeflow.llm import pii


def test_terms_far_from_the_entity(spark):
    filler = ["alpha beta gamma delta", "one two three four five", "red green blue", "north south east west"]
    rows = [(i, f"{filler[i % 4]} number {i} falkenhorst wrote from boss@corp.example about item {i * 7}") for i in range(6)]
    rows += [(100 + i, f"{filler[i % 4]} about number {i} and item {i}") for i in range(200)]
    rows.append((400, "boss@corp.example " + "red green blue " * 20 + "falkenhorst again"))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any("falkenhorst" in t for t in clean.values())
