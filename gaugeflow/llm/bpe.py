"""BPE encoding and decoding by traversal of a prefix-sharing trie.

The distinct pre-tokens of the texts go into a trie in sorted order, which is the depth-first order.
Each node (a prefix) keeps its *last token*: the one token that ends the prefix's encoding. A token
that is a suffix of the prefix is that last token exactly if it is compatible with the last token of
the prefix before it, i.e. if the merges leave the two side by side. So a node's state needs only its
ancestors' states, and an encoding shared as a prefix by many words is computed once. A word's ids
are read by walking back from its node, token by token.

Behaviour: null text counts as empty and has no tokens; every other text is encoded whole, in UTF-8
bytes; strings of special tokens become their ids, as the library does by default. Repeated rows give
repeated results, extra columns are ignored by ``encode`` unless named in ``keep``. The trie and
the cache of words are dropped when they pass ``NODES`` nodes; dropped words are computed anew.
No shuffle: each partition encodes its own rows, so a lost executor costs only its tasks.
"""

import hashlib
import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import chunks, ids_and_texts, text_or_empty, worker_object
from gaugeflow.session import ship

NODES = 500_000
NEVER = 1 << 60
#: Words of more bytes have no nodes, whose keys would take the square of their length.
LONG = 80
#: The pre-token pattern of byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same tokens on texts without the characters of UNUSUAL, from the faster standard library.
COMMON = r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s\w]+|\s+(?!\S)|\s+"
UNUSUAL = r"[^\x09-\x0D\x20-\x5E\x60-\x7EÀ-ÖØ-öø-ÿ]"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, others for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, merge ranks and special tokens of a byte-level BPE file, given as its JSON text."""

    def __init__(self, source: str):
        spec = json.loads(source)
        letters = byte_alphabet()
        raw = lambda token: bytes(letters[c] for c in token)
        self.ids = {raw(token): i for token, i in spec["model"]["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): rank for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.longest = max(map(len, self.ids))
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.tokens: list[bytes] = [b""] * size
        for token, i in self.ids.items():
            self.tokens[i] = token
        for token, i in self.special.items():
            self.tokens[i] = token.encode()

    def merge(self, piece: bytes) -> list[bytes]:
        """The encoding by the definition: apply the lowest-ranked merge, leftmost first, until none applies."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(pair, NEVER), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == NEVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def last_merge(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts whose merge completes the token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            _, i = min((self.ranks.get(pair, NEVER), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]


def worker_encoder(source: str) -> "TrieEncoder":
    """This worker process's encoder of a vocabulary; the trie outlives a task."""
    return worker_object(("bpe", hash(source)), lambda: TrieEncoder(Vocabulary(source)))


class TrieEncoder:
    """Encodes words with one trie that grows until ``NODES`` nodes and then starts anew."""

    def __init__(self, vocabulary: Vocabulary, nodes: int = NODES):
        self.v, self.limit = vocabulary, nodes
        self.beside: dict[tuple[bytes, bytes], bool] = {}
        self.spines: dict[bytes, tuple[list, list] | None] = {}
        self.pack = {token: i.to_bytes(4, "little") for token, i in vocabulary.ids.items()}
        self.clear()
        self.common, self.general, self.unusual = re.compile(COMMON), regex.compile(PATTERN), re.compile(UNUSUAL)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None

    def clear(self) -> None:
        self.last: dict[bytes, bytes] = {b"": b""}  # the trie's nodes, by prefix
        self.known: dict[str, bytes] = {}

    def edges(self, token: bytes) -> tuple[list, list] | None:
        """What stands at the token's left and right edge while it is merged: (part, rank of the merge that ends it).

        None if the token's own bytes do not encode to it.
        """
        if token not in self.spines:
            found = None
            if len(token) == 1:
                found = [(token, NEVER)], [(token, NEVER)]
            elif self.v.merge(token) == [token]:
                a, b = self.v.last_merge(token)
                rank = self.v.ranks[a, b]
                left, right = self.edges(a)[0], self.edges(b)[1]
                found = [(p, min(r, rank)) for p, r in left] + [(token, NEVER)], [(p, min(r, rank)) for p, r in right] + [(token, NEVER)]
            self.spines[token] = found
        return self.spines[token]

    def compatible(self, left: bytes, right: bytes) -> bool:
        """Whether the merges leave ``left`` and ``right`` side by side: no merge across the border comes before those that end its two parts."""
        if (ok := self.beside.get((left, right))) is None:
            if len(self.beside) > 400_000:
                self.beside.clear()
            ok, mine, ranks = True, self.edges(right), self.v.ranks
            if mine is None:
                ok = False
            elif left:  # anything that encodes to itself may begin a word
                for p, p_ends in self.edges(left)[1]:
                    for q, q_ends in mine[0]:
                        rank = ranks.get((p, q), NEVER)
                        if rank < p_ends and rank <= q_ends and rank < NEVER:  # of two equal merges the left one comes first
                            ok = False
            self.beside[left, right] = ok
        return ok

    def insert(self, word: bytes) -> bytes:
        """Adds a word's nodes and returns its packed ids. Words over LONG bytes are walked in the same way but leave no nodes."""
        n = len(word)
        if n > LONG:
            return self.long(word)
        last, ids, beside = self.last, self.v.ids, self.beside
        known = n
        while word[:known] not in last:
            known -= 1
        token = last[word[:known]]
        for depth in range(known + 1, n + 1):
            # Only one token can be the last, so the order of the tries is free: first the parent's with one byte more, then short ones.
            start, then = depth - 1 - len(token), depth - 1
            while True:
                token = word[start:depth]
                if token in ids:
                    before = last[word[:start]]
                    ok = beside.get((before, token))
                    if ok or (ok is None and self.compatible(before, token)):
                        break
                start, then = then, then - 1
            last[word[:depth]] = token
        out = []
        while n:
            token = last[word[:n]]
            out.append(self.pack[token])
            n -= len(token)
        out.reverse()
        return b"".join(out)

    def long(self, word: bytes) -> bytes:
        ids, last = self.v.ids, [b""]
        for depth in range(1, len(word) + 1):
            for start in range(depth - 1, max(-1, depth - 1 - self.v.longest), -1):
                token = word[start:depth]
                if token in ids and self.compatible(last[start], token):
                    last.append(token)
                    break
        out, n = [], len(word)
        while n:
            out.append(self.pack[last[n]])
            n -= len(last[n])
        out.reverse()
        return b"".join(out)

    def learn(self, words: set[str]) -> None:
        """Inserts the words that are not known, in depth-first order."""
        if len(self.last) > self.limit or len(self.known) > self.limit:
            self.clear()
        for word in sorted(w.encode() for w in words - self.known.keys()):
            self.known[word.decode()] = self.insert(word)

    def words(self, text: str) -> list[str]:
        return (self.general if self.unusual.search(text) else self.common).findall(text)

    def pieces(self, text: str) -> list[str]:
        """Texts at even places, special tokens at odd ones."""
        return self.split.split(text) if self.split else [text]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [[self.words(p) if not i % 2 else p for i, p in enumerate(self.pieces(t))] for t in texts]
        self.learn(set().union(*(ws for parts in cut for ws in parts[::2])))
        get, special = self.known.__getitem__, self.v.special
        return [b"".join(map(get, parts[0])) if len(parts) == 1 else b"".join(b"".join(map(get, p)) if not i % 2 else special[p].to_bytes(4, "little") for i, p in enumerate(parts)) for parts in cut]

    def decode(self, packed: bytes) -> str:
        tokens = self.v.tokens
        return b"".join([tokens[i] for i in np.frombuffer(packed, "<u4").tolist()]).decode("utf-8", "replace")


def read_vocabulary(path: str) -> str:
    """The vocabulary file, read on the driver; it is a few MB and goes to the workers as a broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text", digests_only: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, ids (array<int>), n_tokens, decoded text and the SHA-256 of ids and decoded text, and the columns ``keep`` of ``docs``; ``digests_only`` leaves ids and text out."""
    spark = docs.sparkSession
    ship(spark)
    source = spark.sparkContext.broadcast(read_vocabulary(path or default_path()))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ("" if digests_only else ", ids array<int>, decoded string")
    own = ids_and_texts(docs, id_column, text_column) if not keep else docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    schema += "".join(f", c{i} {own.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(source.value)
        for part, texts in chunks(batches):
            packed = encoder.encode(texts)
            decoded = [encoder.decode(x) for x in packed]
            columns = [part.column(0), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if not digests_only:
                columns += [pa.array([np.frombuffer(x, "<i4") for x in packed], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            kept = range(2, part.num_columns)
            yield pa.RecordBatch.from_arrays(columns + [part.column(i) for i in kept], names + [f"c{i - 2}" for i in kept])

    out = own.mapInArrow(run, schema)
    return out.toDF(*out.columns[: len(out.columns) - len(keep)], *keep) if keep else out


def decode(tokens: DataFrame, path: str | None = None, ids_column: str = "ids") -> DataFrame:
    """Adds ``decoded`` (string) to ``tokens`` from an array of ids; a null array decodes to the empty text."""
    spark = tokens.sparkSession
    ship(spark)
    source = spark.sparkContext.broadcast(read_vocabulary(path or default_path()))

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = worker_encoder(source.value)
        for ids in batches:
            yield pd.Series([encoder.decode(np.asarray([] if x is None else x, "<u4").tobytes()) for x in ids], dtype="object")

    return tokens.withColumn("decoded", text(F.col(ids_column)))
