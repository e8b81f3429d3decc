"""Language identification by word-first backoff.

A known word adds its log frequency in each language. An unknown word backs off: from left to right,
at each place the longest known character n-gram (5 to 1 letters, word ends marked) adds the log
frequency of its last letter given what precedes it, so shorter n-grams count only where longer ones
were never seen. The language of the highest sum is the prediction; the score is its share of the
posterior per word, which stays comparable between short and long texts.

Fitting: a bounded sample of labelled rows (``sample_rows`` of lowest hash of the id, as many of them as have ``sample_chars`` characters together) with
its words seen ``min_count`` times and its n-grams; bounds on both tables are parameters. Prediction:
every whole text, in the rows' own partitions, without a shuffle; a very long text is a chunk of its own.

Behaviour: a text that is null or has no letter (numerals and marks are none) is `und` with score 0; without any labelled row all
texts are `und`; an empty table stays empty. Equal sums go to the language first by name. Case is folded. Repeated rows
get equal results; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import bounded_ids, chunks, ids_and_texts, worker_object
from gaugeflow.session import ship

SAMPLE_ROWS, SAMPLE_CHARS, MAX_WORDS, MAX_GRAMS, MIN_COUNT, ORDER = 3000, 20_000_000, 20_000, 40_000, 2, 5
WORD = re.compile(r"[^\W\d_]+")
CACHE = 200_000


def letters_of(run: str) -> list[str]:
    """The parts of a run of word characters that are letters. Numerals such as a superscript two or a circled one are word characters of the pattern, but no letters."""
    return [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()


def words_of(text: str) -> list[str]:
    return [w for run in WORD.findall(text.lower()) for w in letters_of(run)]


class Model:
    """Word and n-gram scores: rows of log frequencies by language."""

    def __init__(self, languages: list[str], words: dict[str, tuple], grams: dict[str, tuple], prior: list[float], order: int = ORDER):
        self.languages, self.words, self.grams, self.prior, self.order = languages, words, grams, prior, order


def fit(rows: list[tuple[str, str]], max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS, min_count: int = MIN_COUNT, order: int = ORDER) -> Model:
    """Model of (language, text) rows; ``max_words`` and ``max_grams`` bound each language's tables."""
    languages = sorted({lang for lang, _ in rows})
    words = {x: Counter() for x in languages}
    docs = Counter(lang for lang, _ in rows)
    for lang, text in rows:
        words[lang].update(words_of(text))
    known = {w for x in languages for w, n in words[x].most_common(max_words) if n >= min_count}
    totals = {x: sum(words[x].values()) + len(known) + 1 for x in languages}
    word_rows = {w: tuple(math.log((words[x][w] + 0.5) / totals[x]) for x in languages) for w in known}
    # n-grams of distinct words, so that frequent words do not stand for all others
    counts = {x: Counter() for x in languages}
    for x in languages:
        for w in words[x]:
            marked = f" {w} "
            for n in range(1, order + 1):
                for i in range(len(marked) - n + 1):
                    counts[x][marked[i : i + n]] += 1
    letters = len({g for x in languages for g in counts[x] if len(g) == 1}) + 1
    kept = {g for x in languages for g, n in counts[x].most_common(max_grams) if n >= min_count or len(g) == 1}
    ones = {x: sum(n for g, n in counts[x].items() if len(g) == 1) for x in languages}
    gram_rows = {}
    for g in kept:
        row = []
        for x in languages:
            before = counts[x][g[:-1]] if len(g) > 1 else ones[x]
            row.append(math.log((counts[x][g] + 0.5) / (before + 0.5 * letters)))
        gram_rows[g] = tuple(row)
    return Model(languages, word_rows, gram_rows, [math.log((docs[x] + 1) / (len(rows) + len(languages))) for x in languages], order)


class Scorer:
    def __init__(self, model: Model):
        self.m = model
        self.size = len(model.languages)
        self.known = {w: i for i, w in enumerate(model.words, 1)}
        self.grams = {g: i for i, g in enumerate(model.grams, 1 + len(model.words))}
        self.scores = np.array([[-math.log(1e6)] * self.size, *model.words.values(), *model.grams.values()])
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((0, self.size))
        self.odd = np.zeros(0, bool)

    def learn(self, words: set[str]) -> None:
        """Score rows of words not met yet, after the others are dropped if they are many."""
        if len(self.at) > CACHE:
            self.clear()
        self.extend(words)

    def extend(self, words: set[str]) -> None:
        """A known word has its own row, another the sum of the rows that its places back off to."""
        new = list(words - self.at.keys())
        if not new:
            return
        known, get, order = self.known, self.grams.get, self.m.order
        flat: list[int] = []
        starts: list[int] = []
        for w in new:
            starts.append(len(flat))
            if (row := known.get(w)) is not None:
                flat.append(row)
                continue
            marked = f" {w} "
            for end in range(2, len(marked) + 1):
                row = None
                for start in range(end - order if end > order else 0, end):
                    row = get(marked[start:end])
                    if row is not None:
                        break
                flat.append(row or 0)  # row 0: never seen
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        self.table = np.concatenate([self.table, np.add.reduceat(self.scores[flat], starts)])
        self.odd = np.concatenate([self.odd, [not w.isalpha() for w in new]])

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        split = [WORD.findall(t.lower()) for t in texts]
        if self.size:
            self.learn(set().union(*split))
        rows = lambda words: np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        langs, scores = [], []
        for words in split:
            if words and self.size and self.odd[at := rows(words)].any():
                # some run holds what is no letter: such texts are taken apart once more
                words = [w for run in words for w in letters_of(run)]
                if not self.at.keys() >= set(words):
                    self.extend(set(words))
                at = rows(words)
            if not words or not self.size:
                langs.append("und")
                scores.append(0.0)
                continue
            total = (self.table[at].sum(0) + self.m.prior) / len(words)
            best = int(np.argmax(total))
            langs.append(self.m.languages[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return langs, scores


def training_sample(docs: DataFrame, where: Column, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(language, text) of at most ``rows`` labelled rows, those whose ids have the lowest hashes, as long as their texts have ``chars`` characters together."""
    d = docs.where(where & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = bounded_ids(d.select(F.col("doc_id"), F.xxhash64("doc_id").alias("h"), F.char_length(F.col("text").cast("string")).alias("size")), rows, chars)
    found = d.join(F.broadcast(ids), "doc_id", "left_semi").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id").alias("h"), "doc_id")
    return [(r[0], r[1]) for r in found.orderBy("h", "doc_id", "lang", "text").limit(rows).select("lang", "text").collect()]


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # bounded by max_words and max_grams a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_object(("langid", id(sent.value)), lambda: Scorer(sent.value))
        for part, texts in chunks(batches):
            langs, scores = scorer.predict(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return ids_and_texts(docs, id_column, text_column).mapInArrow(run, "doc_id long, lang_pred string, score double")
