"""Words of any length and capitals with accents count."""

from gaugeflow.llm import rules


def test_long_words_and_accented_capitals(spark):
    d = spark.createDataFrame([("xx", "ÄPFEL " + "zusammenhang gesellschaft gesellschaft " * 3), ("yy", "東京都知事選挙管理委員会")], "lang string, text string")
    refs = rules.learn(d)
    assert refs.words["xx"] == ["gesellschaft", "zusammenhang", "äpfel"] and refs.words["yy"] == ["東京都知事選挙管理委員会"]
    assert refs.shares["yy"][0] == 1.0 and len(refs.shares["yy"]) == 2
    text = d.first()["text"]
    counts = [len("zusammenhanggesellschaftgesellschaft") * 3, text.count(" "), 5, 0, 0, 0, 0]
    assert [round(x * len(text), 9) for x in refs.classes["xx"]] == counts


def test_every_spelling_counts(spark):
    d = spark.createDataFrame([(1, "xx", "the cat The dog THE tHe " * 20)], "doc_id long, lang string, text string")
    refs = rules.learn(d)
    assert refs.words["xx"] == ["cat", "dog", "the"] and refs.shares["xx"] == [1 / 6, 1 / 6, 4 / 6, 0.0]
    row = rules.score(d, refs).first()
    assert row["word_distance"] < 1e-6 and row["class_distance"] < 1e-6
