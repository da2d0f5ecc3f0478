"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled into a deterministic automaton over tokens that accepts exactly the merged spellings. It starts as
one state with an arc for every byte. The merge of u and v puts a gadget in: the state that u leads to gets a copy without
the v arc, u's arcs go to the copy, and wherever u has an arc, so has the merged token, to where v led. All arcs of a token
thus lead to one state, and a state is a chain of copies: it is stored as "token and merge number", with the arcs that the
copies lost (`lost[u][v]` = number of the merge). An arc of a later token exists where its first part's arc did when the
token was made, so looking an arc up walks two short chains; looked-up arcs go to a transition table.

A pre-split word has exactly one accepted spelling, and so has each prefix: one pass over the word keeps the last arc of
every prefix. Decoding emits the labels (bytes) of the arcs. Words are few kinds, so a bounded table keeps each word's arcs.

Cases: null text is empty text: no tokens; empty text likewise; added tokens (as <|endoftext|>) are cut out first and have
their own ids; very long words take time and memory in proportion to their length; a null doc_id stays null; repeated rows
give repeated results; an empty table gives an empty result; other columns are ignored (tokens keeps them, but for those named ids or
decoded, which give way).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import corpus, hide, show

NEVER = 1 << 60
WORDS_KEPT = 100_000
ARCS_KEPT = 150_000
#: Unicode's White_Space, which the split pattern's \s means.
SPACE = r"\t-\r\x20\x85\xa0  -     　"
#: Fixed value: the byte-level split pattern.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: The same split for texts of ASCII, Latin-1 and extended Latin letters only, by the quicker standard engine.
LATIN = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
EASY = rf"\x00-\x1b\x20-\x84\x86-\x9f¡-±´¶-¸»¿×÷{LATIN}"
PLAIN = rf" ?[{LATIN}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\t-\r\x200-9{LATIN}]+|[\t-\r\x20]+(?![^\t-\r\x20])|[\t-\r\x20]+"


class Arcs(dict):
    """The transition table: state token << shift | next token -> is there an arc? Filled as it is asked."""

    def __init__(self, arc, shift: int):
        self.arc, self.shift = arc, shift

    def __missing__(self, key: int) -> bool:
        ok = self[key] = self.arc(key >> self.shift, key & (1 << self.shift) - 1)
        return ok


@cache
def byte_letters() -> dict[str, int]:
    """The printable letter that a byte-level vocabulary writes for each byte, as letter -> byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """From a byte-level BPE tokenizer file's vocabulary, merges and added tokens."""

    def __init__(self, vocab: dict[str, int], merges: list, added: dict[str, int]):
        letters = byte_letters()
        self.label = [b""] * (1 + max([*vocab.values(), *added.values(), 0]))
        self.number: dict[bytes, int] = {}
        for token, i in vocab.items():
            self.label[i] = bytes(letters[c] for c in token)
            self.number[self.label[i]] = i
        self.added = added
        for token, i in added.items():
            self.label[i] = token.encode()
        n = len(self.label)
        self.made = [-1] * n  # the merge that made a token; -1 for a byte
        self.left, self.right = [-1] * n, [-1] * n
        self.lost: list[dict[int, int]] = [{} for _ in range(n)]
        for k, pair in enumerate(merges):
            u, v = (vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self._gadget(k, u, v)
        self._start()

    @classmethod
    def load(cls, path: str) -> Automaton:
        with open(path, encoding="utf-8") as f:
            t = json.load(f)
        return cls(t["model"]["vocab"], t["model"]["merges"], {x["content"]: x["id"] for x in t["added_tokens"]})

    def _gadget(self, k: int, u: int, v: int) -> None:
        if not self.arc(u, v):
            return  # no spelling has the pair any more
        w = self.number[self.label[u] + self.label[v]]
        self.lost[u][v] = k  # u's arcs now go to a copy without the v arc
        self.made[w], self.left[w], self.right[w] = k, u, v  # w's arcs go where v's went before this merge

    def arc(self, t: int, x: int) -> bool:
        """Does the state after token t have an arc of x?"""
        lost = self._copies(t)
        until_x = NEVER
        while x >= 0:
            for own, until in lost:
                k = own.get(x)
                if k is not None and k < until and k <= until_x:
                    return False
            until_x, x = self.made[x], self.left[x]
        return True

    def _copies(self, t: int) -> list[tuple[dict[int, int], int]]:
        """The chain of copies that the state after t is: the arcs lost, and the merge up to which they count."""
        out, until = [], NEVER
        while t >= 0:
            if self.lost[t]:
                out.append((self.lost[t], until))
            until, t = self.made[t], self.right[t]
        return out

    def _start(self) -> None:
        #: Finds the arcs that end at each byte of a word.
        self.trie = ahocorasick.Automaton()
        for b, i in self.number.items():
            self.trie.add_word(b.decode("latin-1"), (i, len(b)))
        self.trie.make_automaton()
        self.words: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}
        self.shift = len(self.label).bit_length()  # room for any token number
        self.arcs = Arcs(self.arc, self.shift)
        self.plain = re.compile(PLAIN).findall
        self.odd = re.compile(f"[^{EASY}]").search
        self.parts = regex.compile(SPLIT).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "before", "arcs", "plain", "odd", "parts", "cut", "trie")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def spell(self, word: bytes) -> tuple[int, ...]:
        """The accepted token sequence. A prefix has one too, so its last arc says all: the arcs that end at each byte
        are tried, longest first, against the state that the prefix before them leads to."""
        arcs, shift, last = self.arcs, self.shift, [-1] * (len(word) + 1)
        if len(arcs) > ARCS_KEPT:
            arcs.clear()
        for end, (x, size) in self.trie.iter(word.decode("latin-1")):
            end += 1
            if last[end] < 0:
                start = end - size
                if not start or ((t := last[start]) >= 0 and arcs[t << shift | x]):
                    last[end] = x
        out, end = [], len(word)
        while end:
            if (x := last[end]) < 0:
                raise ValueError("no spelling: the vocabulary lacks a byte of the text")
            out.append(x)
            end -= len(self.label[x])
        return tuple(out[::-1])

    def encode(self, text: str) -> list[int]:
        if self.cut is None or not any(a in text for a in self.added):
            return self._encode(text)
        ids: list[int] = []
        for i, part in enumerate(self.cut(text)):
            if i % 2:
                ids.append(self.added[part])
            elif part:
                ids += self._encode(part)
        return ids

    def _encode(self, text: str) -> list[int]:
        parts, words = (self.parts if self.odd(text) else self.plain)(text), self.words
        new = set(parts).difference(words)
        if len(words) + len(new) > WORDS_KEPT:  # the last generation stays at hand while a new one fills
            self.before, self.words = words, (words := {})
            new = set(parts)
        for w in new:
            words[w] = self.before.get(w) or self.spell(w.encode())
        return list(chain.from_iterable(map(words.__getitem__, parts)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.label.__getitem__, ids))


_live: list[Automaton] = []


def _current(a: Automaton) -> Automaton:
    """a, after letting go of the automaton that this worker had before: one at a time is in memory."""
    if _live and _live[0] is not a:
        _live[0].__dict__.clear()
    _live[:] = [a]
    return a


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def tokens(docs: DataFrame, path: str | None = None, decode: bool = False) -> DataFrame:
    """All columns of docs, and ids array<int>: the tokens of text; with decode also decoded, the text that the ids alone give."""
    auto = docs.sparkSession.sparkContext.broadcast(Automaton.load(path or default_path()))
    hidden, names, text = hide(docs)
    given = hidden.withColumn("whole", F.coalesce(F.col(text).cast("string"), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _current(auto.value)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids = [a.encode(t) for t in part.column(part.num_columns - 1).to_pylist()]
                more = [pa.array(ids, pa.list_(pa.int32()))]
                if decode:
                    more.append(pa.array([a.decode(x) for x in ids], pa.binary()).cast(pa.string()))
                yield pa.record_batch([*part.columns[:-1], *more], [*part.schema.names[:-1], "ids", "decoded"][: part.num_columns - 1 + len(more)])

    more = {"ids": "array<int>"} | ({"decoded": "string"} if decode else {})
    schema = hidden.select("*", *(F.lit(None).cast(t).alias(n) for n, t in more.items())).schema
    return show(given.mapInArrow(run, schema), names, *more)


def tokens_and_text(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, decoded."""
    return tokens(docs.select("doc_id", "text"), path, decode=True).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The digest: doc_id, n_tokens, ids_sha256, decoded_sha256; the text is encoded, then decoded from the ids alone."""
    auto = docs.sparkSession.sparkContext.broadcast(Automaton.load(path or default_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _current(auto.value)
        names = [str(i) for i in range(len(a.label))]
        for b in batches:
            n, ids_hash, text_hash = [], [], []
            for scalar in b.column(1):
                ids = a.encode(scalar.as_py())
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                text_hash.append(hashlib.sha256(a.decode(ids)).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(corpus(spark, sf_dir))
