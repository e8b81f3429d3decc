"""Quality rules by distribution divergence, in DataFrame functions only.

Two histograms of a document, over character classes and over common words, are compared with those
of each language by the Jensen-Shannon distance (square root of the divergence in bits). A document
is kept if, for some language, both distances stay under their limits; a histogram of fewer counts
than its minimum decides nothing. The references are learned from all documents with a language:
``learn`` counts every word of every text once, in parallel, and only the ``common`` most frequent
words of each language reach the driver.

Behaviour: null text counts as empty (no words, fails the base rule); documents of null language take
part in scoring, not in learning; without any reference the divergence rule keeps everything. Ties
between equally frequent words go to the smaller word. Repeated rows get equal results; extra
columns are left alone. No shuffle in scoring: a row needs nothing but itself and the references.
Five-word windows are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.common import text_or_empty

#: White space between words (fixed value).
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: What most characters are: small letters and white space. Without them a text is short, and other characters are counted in what is left.
PLAIN = r"[a-z\x20\x09-\x0D]+"
#: Patterns of the other classes; with small letters, white space and the rest they make the histogram, which sums to the text's characters.
CLASSES = {"upper": "[A-ZÀ-ÖØ-Þ]", "digit": "[0-9]", "mark": "[.,;:!?'\"()-]", "symbol": SYMBOLS}
N_CLASSES = len(CLASSES) + 3
MIN_WORDS, REPEATED_PERCENT, WINDOW = 10, 20, 5


@dataclass(frozen=True)
class Rules:
    """Limits of the divergence rule; distances lie between 0 and 1."""

    common: int = 24
    class_limit: float = 0.3
    word_limit: float = 0.48
    min_chars: int = 300
    min_words: int = 60


@dataclass(frozen=True)
class References:
    """Per language: shares of the character classes; its common words and their shares, the last share being all other words'."""

    classes: dict[str, list[float]] = field(default_factory=dict)
    words: dict[str, list[str]] = field(default_factory=dict)
    shares: dict[str, list[float]] = field(default_factory=dict)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def chars_in(words: Column) -> Column:
    return F.char_length(F.array_join(words, ""))


def odd_characters(text: Column) -> Column:
    return F.regexp_replace(text, PLAIN, "")


def class_counts(text: Column, word_chars: Column, odd: Column) -> Column:
    """Counts of the classes: small letters, white space, those of CLASSES, and the rest. ``odd`` is the text without small letters and white space."""
    chars, others = F.char_length(text).cast("double"), F.char_length(odd).cast("double")
    found = [F.regexp_count(odd, F.lit(p)).cast("double") for p in CLASSES.values()]
    rest = others
    for c in found:
        rest = rest - c
    return F.array(word_chars - others, chars - word_chars, *found, rest)


def repeated_words(n: Column, hashes: Column, kinds: Column) -> Column:
    """Words that lie in a window found twice or more, each word once; ``hashes`` of all windows, ``kinds`` of them."""

    # sorted by (hash, place), equal windows are neighbours; a place counts for what its predecessor among all repeated places leaves uncovered
    def places(s: Column) -> Column:
        same = lambda i, j: F.get(s, j)["h"] == F.get(s, i)["h"]
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda i: F.get(s, i)["i"]))

    def covered(p: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
        return F.aggregate(p, zero, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i + WINDOW - a["to"])).alias("n"), (i + WINDOW).alias("to")), lambda a: a["n"])

    with_value = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  evaluates ``value`` once
    placed = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when((n <= WINDOW) | (kinds == F.size(hashes)), F.lit(0)).otherwise(with_value(placed, lambda s: with_value(places(s), covered)))


def base(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text, words and the base counts. Each step is a projection, so that what several columns use is computed once."""
    d = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(" \t\n\u000b\f\r")) != "")
    d = d.withColumns({"words": words_of(F.col("text")), "lines": lines, "odd": odd_characters(F.col("text"))})
    # every word is hashed once, a window from the hashes of its words
    d = d.withColumn("hashed", F.transform("words", lambda w: F.xxhash64(w)))
    windows = F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*[F.get("hashed", i + j) for j in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumns({"n_words": F.size("words").cast("long"), "word_chars": chars_in(F.col("words")).cast("long"), "hashes": windows})
    d = d.withColumn("kinds", F.size(F.array_distinct("hashes")))
    return d.select(
        "doc_id", "text", "words", "odd", "n_words", "word_chars", F.regexp_count("odd", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("n_words"), F.col("hashes"), F.col("kinds")).cast("long").alias("n_repeat_words"),
    )


def learn(docs: DataFrame, rules: Rules = Rules(), text_column: str = "text", lang_column: str = "lang") -> References:
    """References of every language, from all its texts. What reaches the driver: one row a language, and ``common`` words of each."""
    d = docs.where(F.col(lang_column).isNotNull()).select(F.col(lang_column).cast("string").alias("lang"), text_or_empty(text_column).alias("text"))
    d = d.withColumns({"words": words_of(F.col("text")), "odd": odd_characters(F.col("text"))})
    counts = class_counts(F.col("text"), chars_in(F.col("words")).cast("double"), F.col("odd"))
    sums = d.select("lang", counts.alias("c"), F.size("words").alias("n")).groupBy("lang").agg(*[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(N_CLASSES)], F.sum("n").alias("n")).orderBy("lang").collect()
    classes = {r["lang"]: [r[f"c{i}"] / max(1.0, sum(r[f"c{j}"] for j in range(N_CLASSES))) for i in range(N_CLASSES)] for r in sums}
    totals = {r["lang"]: r["n"] for r in sums}
    # Every word counts, whatever its length; shares are of all words.
    per_word = d.select("lang", F.explode(words_of(F.lower("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    # Top words in two steps, so that no task ranks all words of a language.
    order = [F.col("n").desc(), F.col("word")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("word"), F.lit(64))).orderBy(*order)
    first = per_word.withColumn("r", F.row_number().over(part)).where(F.col("r") <= rules.common)
    last = first.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= rules.common)
    tops: dict[str, dict[str, float]] = {}
    for r in last.orderBy("lang", "word").collect():
        tops.setdefault(r["lang"], {})[r["word"]] = r["n"] / totals[r["lang"]]
    return References(classes, {k: list(v) for k, v in tops.items()}, {k: [*v.values(), max(0.0, 1 - sum(v.values()))] for k, v in tops.items()})


def distance(counts: Column, total: Column, shares: list[float]) -> Column:
    """Jensen-Shannon distance between an array of counts, which sum to ``total``, and shares of the same order; 1 if there are no counts."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    t = F.greatest(total, F.lit(1.0))
    both = F.zip_with(counts, F.array(*map(F.lit, shares)), lambda c, q: part(c / t, (c / t + q) / 2) + part(q, (c / t + q) / 2))
    return F.when(total > 0, F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / 2))).otherwise(F.lit(1.0))


def score(docs: DataFrame, references: References, rules: Rules = Rules(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Base counts, base_failed, language (the nearest reference), class_distance, word_distance and kept of every document."""
    d = base(docs, id_column, text_column)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    d = d.withColumn("base_failed", failed)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    if not references.classes:
        return d.select(*columns, F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("class_distance"), F.lit(None).cast("double").alias("word_distance"), (~F.col("base_failed")).alias("kept"))
    every = sorted({w for ws in references.words.values() for w in ws})
    d = d.withColumns({"classes": class_counts(F.col("text"), F.col("word_chars").cast("double"), F.col("odd")), "chars": F.char_length("text").cast("double")})
    # case is folded here as it was when the words were learned
    d = d.withColumn("known", F.sort_array(F.transform(F.filter("words", lambda w: F.lower(w).isin(*every) if every else F.lit(False)), lambda w: F.lower(w))))
    d = d.withColumn("kinds", F.array_distinct("known"))
    starts = F.concat(F.transform("kinds", lambda w: F.array_position("known", w)), F.array((F.size("known") + 1).cast("long")))
    d = d.withColumn("starts", starts)
    d = d.withColumn("counts", F.map_from_arrays("kinds", F.transform("kinds", lambda w, i: (F.get("starts", i + 1) - F.get("starts", i)).cast("double"))))
    languages = list(references.classes)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    # Each step is a projection of its own: an expression that several others use is computed once.
    own = {f"own{i}": F.transform(F.array(*map(F.lit, words)), lambda w: F.coalesce(F.try_element_at(F.col("counts"), w), F.lit(0.0))) if (words := references.words.get(x)) else F.array().cast("array<double>") for i, x in enumerate(languages)}
    d = d.withColumns(own | {"n": F.col("n_words").cast("double")})
    d = d.withColumns({f"all{i}": F.concat(f"own{i}", F.array(F.col("n") - total(F.col(f"own{i}")))) for i in range(len(languages))})
    by = {}
    for i, lang in enumerate(languages):
        by[f"class{i}"] = F.when(F.col("chars") < rules.min_chars, F.lit(0.0)).otherwise(distance(F.col("classes"), F.col("chars"), references.classes[lang]))
        by[f"word{i}"] = F.when(F.col("n") < rules.min_words, F.lit(0.0)).otherwise(distance(F.col(f"all{i}"), F.col("n"), references.shares.get(lang, [1.0])))
    d = d.withColumns(by)
    # the language whose larger distance, as a part of its limit, is least; ties to the first by name
    d = d.withColumn("best", F.array_min(F.array(*[F.struct(F.greatest(F.col(f"class{i}") / rules.class_limit, F.col(f"word{i}") / rules.word_limit).alias("worst"), F.lit(lang).alias("language"), F.col(f"class{i}").alias("class_distance"), F.col(f"word{i}").alias("word_distance")) for i, lang in enumerate(languages)])))
    return d.select(*columns, "best.language", "best.class_distance", "best.word_distance", (~F.col("base_failed") & (F.col("best.worst") <= 1)).alias("kept"))
