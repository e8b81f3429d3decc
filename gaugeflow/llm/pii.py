"""Information-theoretic sanitisation of personal data.

Protected entities are the e-mail addresses, IP addresses, card and phone numbers that patterns find.
A term near an entity can give it away though it is no such pattern itself: a code name that
stands only beside one address. How much a term t reveals of an entity c is estimated from the corpus as

    disclosure(t, c) = PMI(t; c) / IC(c),   PMI = log(N n_ct / (n_c n_t)),   IC = log(N / n_c)

with n_c the documents that hold c, n_ct those of them that hold t within ``WORDS`` words of it, n_t the documents
that hold t anywhere, N all documents. It is 1 if t occurs nowhere else, however often the documents are copied, since
every count is one of documents. In every text that holds c, a term of at least ``generalise`` is replaced by its kind, one of at
least ``remove`` taken out. What speaks for a disclosure must be said more than once: ``support`` different windows
(the words around c) are needed, so copies of one document prove nothing.

Three passes over the texts: windows (which only texts with entities have), counts of the candidate terms
in all documents, and the result. A pair of entity and term that cannot reach ``generalise`` even if the term stood in no other document than
those seen is no candidate. Candidates are counted in chunks of ``chunk_terms``, each of which a broadcast holds; their number has no bound.

Behaviour: null text counts as empty and has no spans; a very long text is read as a whole. Positions are code points, ends exclusive. Spans
of one kind do not overlap, a term never overlaps a pattern's span. Repeated rows get equal results, an empty table an empty one.
``sanitise`` keeps all columns, whatever their names, and changes only the text; a null text stays null.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import CHUNK_CHARS, chunks, fresh, ids_and_texts, numbered, worker_release
from gaugeflow.session import discard, materialise, ship

KINDS = ("email", "ip", "card", "phone")
WORDS = 8
#: Fixed patterns. The e-mail's local part is read back from its @; possessive repeats keep the others linear.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
TERM = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Policy:
    """Disclosure from which a term is generalised and from which it is removed; different windows that it takes to say so; terms counted at a time."""

    generalise: float = 0.6
    remove: float = 0.85
    support: int = 3
    chunk_terms: int = 200_000


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the patterns, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(map(m[0].count, "0123456789")) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(text: str, span: tuple[int, int, int]) -> str:
    """One name for all spellings: case folded, numbers as digits."""
    start, kind, end = span
    raw = text[start:end]
    return f"{KINDS[kind]}:{raw.lower() if kind < 2 else ''.join(c for c in raw if c.isdigit())}"


def windows(text: str, spans: list[tuple[int, int, int]], words: int = WORDS) -> list[tuple[str, list[str]]]:
    """(entity, terms around it) of each span: up to ``words`` whole terms before and after it; terms that touch any span are left out."""
    cover = sorted((a, b) for a, _, b in spans)
    starts = [a for a, _ in cover]
    reach = list(accumulate((b for _, b in cover), max))  # the farthest end so far
    free = []
    for m in TERM.finditer(text):
        before = bisect_left(starts, m.end())  # spans that begin before the term ends
        if not before or reach[before - 1] <= m.start():
            free.append(m)
    begins, ends = [m.start() for m in free], [m.end() for m in free]
    out = []
    for span in spans:
        left, right = bisect_right(ends, span[0]), bisect_left(begins, span[2])
        near = free[max(0, left - words) : left] + free[right : right + words]
        out.append((entity(text, span), [m[0].lower() for m in near]))
    return out


def text_key(text: str) -> str:
    """A name of the text: equal texts are annotated alike."""
    return hashlib.md5(text.encode()).hexdigest()


def find_windows(docs: DataFrame) -> DataFrame:
    """key of the text, entity, the distinct terms of its windows in the document, and each window's hash with its terms; a row for each entity of a document."""
    ship(docs.sparkSession)
    window = pa.struct([("hash", pa.string()), ("terms", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_release()
        for _, texts in chunks(batches):
            rows = []
            for t in texts:
                if spans := base_spans(t):
                    own: dict[str, dict[str, list[str]]] = {}
                    for c, near in windows(t, spans):
                        own.setdefault(c, {})[hashlib.md5(" ".join(near).encode()).hexdigest()] = sorted(set(near))
                    key = text_key(t)
                    rows += [(key, c, sorted(set().union(*seen.values())), [{"hash": h, "terms": terms} for h, terms in seen.items()]) for c, seen in own.items()]
            if rows:
                key, c, terms, seen = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(c), pa.array(terms, pa.list_(pa.string())), pa.array(seen, pa.list_(window))], ["key", "entity", "terms", "windows"])

    return docs.mapInArrow(run, "key string, entity string, terms array<string>, windows array<struct<hash:string,terms:array<string>>>")


def document_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """term and n_t, the number of documents that hold it, for the given terms."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(terms))  # at most chunk_terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for _, texts in chunks(batches):
            for t in texts:
                counts.update(sent.value.intersection(TERM.findall(t.lower())))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    return docs.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosing_terms(docs: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """key of the text, and its terms to be generalised or removed (array of term and action). ``docs`` has doc_id and text."""
    found = materialise(find_windows(docs), "pii-windows")
    distinct = found.select("entity", F.explode("windows").alias("w")).select("entity", "w.hash", "w.terms").dropDuplicates(["entity", "hash"])
    enough = distinct.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("support")).where(F.col("support") >= policy.support)
    n_c = found.groupBy("entity").agg(F.count("*").alias("n_c"))
    n_ct = found.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_ct"))
    # a term stands in at least as many documents as there are different texts with windows that hold it
    least = found.select("key", F.explode("terms").alias("term")).distinct().groupBy("term").agg(F.count("*").alias("least"))
    pairs = enough.join(n_ct, ["entity", "term"]).join(n_c, "entity").join(least, "term")
    empty = docs.sparkSession.createDataFrame([], "key string, hits array<struct<term:string,action:string>>")
    total = docs.count()

    def disclosure(holders: Column) -> Column:
        pmi = F.log(F.lit(float(total)) * F.col("n_ct") / (F.col("n_c") * holders))
        ic = F.log(F.lit(float(total)) / F.col("n_c"))
        return F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0))

    pairs = materialise(pairs.where(disclosure(F.greatest("least", "n_ct")) >= policy.generalise - 1e-9).select("entity", "term", "n_ct", "n_c"), "pii-pairs")
    n_terms = pairs.select("term").distinct().count()
    if not n_terms:
        return empty
    chunks_n = -(-n_terms // policy.chunk_terms)
    counts = None
    for i in range(chunks_n):
        chunk = pairs.where(F.pmod(F.xxhash64("term"), F.lit(chunks_n)) == i).select("term").distinct()
        part = document_counts(docs, [r[0] for r in chunk.collect()])
        counts = part if counts is None else counts.unionByName(part)
    scored = pairs.join(counts, "term").withColumn("disclosure", disclosure(F.col("n_t")))
    flagged = materialise(scored.where(F.col("disclosure") >= policy.generalise).select("entity", "term", F.when(F.col("disclosure") >= policy.remove, "remove").otherwise("generalise").alias("action")), "pii-terms")
    # a text's terms are those of all its entities, wherever in it they stand
    hits = found.select("key", "entity").distinct().join(flagged, "entity").groupBy("key", "term").agg(F.max("action").alias("action"))  # "remove" is the greater word
    out = materialise(hits.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("term", "action"))).alias("hits")), "pii-hits")
    discard(found, pairs, flagged)
    return out


def term_spans(text: str, spans: list[tuple[int, int, int]], hits: dict[str, str]) -> list[tuple[int, int, str]]:
    """(start, end, action) of every occurrence of the terms outside the patterns' spans."""
    if not hits:
        return []
    cover = [(a, b) for a, _, b in spans]
    return [(m.start(), m.end(), action) for m in TERM.finditer(text) if (action := hits.get(m[0].lower())) and not any(a < m.end() and m.start() < b for a, b in cover)]


def with_hits(docs: DataFrame, hits: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with, as its last column, the terms of its text; the planner broadcasts ``hits``, a written table of known size, only if it is small."""
    key, found = fresh(docs, "__key"), fresh(docs, "__hits")
    keyed = docs.withColumn(key, F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    return keyed.join(hits.select(F.col("key").alias(key), F.col("hits").alias(found)), key, "left").select(*[f"`{c}`" for c in docs.columns], found)


def annotate(docs: DataFrame, policy: Policy = Policy(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, kind counts, base_spans and spans (arrays of kind, start, end) of every text; added spans have the kind `generalise` or `remove`."""
    d = ids_and_texts(docs, id_column, text_column)
    d = with_hits(d, disclosing_terms(d, policy))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            base, every, counts = [], [], []
            for t, hits in zip(texts, part.column(2).to_pylist(), strict=True):
                spans = base_spans(t)
                own = [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]
                more = [(a, 4, b, action) for a, b, action in term_spans(t, spans, {h["term"]: h["action"] for h in hits or []})]
                merged = sorted([(a, k, b, KINDS[k]) for a, k, b in spans] + more)
                base.append(own)
                every.append([{"kind": kind, "start": a, "end": b} for a, _, b, kind in merged])
                seen = Counter(k for _, k, _ in spans)
                counts.append([seen[k] for k in range(4)])
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(base, span), pa.array(every, span)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans"])

    kind = "array<struct<kind:string,start:int,end:int>>"
    return d.mapInArrow(run, f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans {kind}, spans {kind}")


def cleaned(text: str, hits: dict[str, str]) -> str:
    """The text with its spans replaced: patterns by their kind, terms by TERM or by nothing. Overlapping spans are replaced as one."""
    spans = base_spans(text)
    cuts = sorted([(a, b, f"[{KINDS[k].upper()}]") for a, k, b in spans] + [(a, b, "" if action == "remove" else "[TERM]") for a, b, action in term_spans(text, spans, hits)])
    out, at = [], 0
    for a, b, mark in cuts:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, policy: Policy = Policy(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with its columns, and personal data and disclosing terms taken out of the text."""
    names = docs.columns
    hits = disclosing_terms(ids_and_texts(docs, id_column, text_column), policy)
    at = names.index(text_column)
    plain = numbered(docs)
    schema, plain_names = plain.schema, plain.columns
    d = with_hits(plain, hits, f"c{at}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, at, CHUNK_CHARS):
            null = part.column(at).is_null().to_pylist()
            terms = part.column(len(names)).to_pylist()
            text = [None if n else cleaned(t, {h["term"]: h["action"] for h in hs or []}) for t, n, hs in zip(texts, null, terms, strict=True)]
            columns = [part.column(i) for i in range(len(names))]
            columns[at] = pa.array(text, part.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=plain_names)

    return d.mapInArrow(run, schema).toDF(*names)
