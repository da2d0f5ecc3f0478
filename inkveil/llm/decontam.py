"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark item is cut into windows of 10 consecutive words (an item of fewer words is one window), and a window into
5-word shingles (a shorter window is one shingle). Shingles are ordered by their document frequency over the whole corpus.
A window occurs only where all its shingles do, so its required prefix is its rarest shingle alone: documents are joined to
windows on that shingle; length and positional bounds discard starts that leave the document; what is left is verified
exactly, shingle by shingle, over the window's size.

The texts are read once: a first pass finds, per document, the places of all benchmark shingles (few) and writes them to
the shared folder; frequencies, join and verification work on that table. The benchmark goes to the executors in blocks of
at most `block_bytes` of text (the size is measured first), which become about 30 times as much in memory at worst, where all words
differ; with several blocks rows are numbered and kept first, each block is a pass over them, and spans and items of a row are put together.

Cases: null text has no words and is clean; null or empty items have no windows; items with equal text all count; a document
is a row, so repeated rows give repeated results; a null doc_id stays null; a null item_id is listed as an empty string;
empty tables give empty or clean results; other columns are ignored (drop_contaminated keeps them, whatever their names).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import ALNUM, Scratch, corpus, doc_id, hide, show, table

WINDOW, SHINGLE = 10, 5
MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ALNUM).split()


class Items:
    """A block of benchmark items: their words and shingles as numbers, laid end to end, and windows as places in that row.

    A window of `size` words that starts at word w has the shingles number[w], number[w + 1], ..., of `part` words each."""

    def __init__(self, rows: list[tuple[str, bytes]], window: int, shingle: int):
        self.names = [name for name, _ in rows]
        self.vocab: dict[bytes, int] = {}
        ids = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)], np.int32) for _, text in rows]
        lengths = np.array([len(x) for x in ids], np.int64)
        begin, flat = np.cumsum(lengths) - lengths, np.concatenate([*ids, np.zeros(shingle, np.int32)])
        self.number, self.tables, self.n = np.full(len(flat), -1, np.int32), {}, 0
        starts, items = [], []
        part_of = np.minimum(np.minimum(lengths, window), shingle)
        for part in sorted({int(p) for p in part_of if p}):
            own = np.flatnonzero(part_of == part)
            at = np.concatenate([np.arange(begin[i], begin[i] + lengths[i] - part + 1) for i in own])
            keys, number = np.unique(np.stack([flat[at + i] for i in range(part)], axis=1), axis=0, return_inverse=True)
            self.number[at] = self.n + number.ravel()
            mixed = self._mix(keys.T)
            order = np.argsort(mixed, kind="stable")
            self.tables[part] = (mixed[order], keys[order], (self.n + order).astype(np.int32))
            self.n += len(keys)
        for i in np.flatnonzero(lengths):
            n = lengths[i] - min(window, lengths[i]) + 1
            starts.append(np.arange(begin[i], begin[i] + n))
            items.append(np.full(n, i))
        self.starts = np.concatenate([*starts, np.zeros(0, np.int64)]).astype(np.int32)
        self.items = np.concatenate([*items, np.zeros(0, np.int64)]).astype(np.int32)
        self.sizes = np.minimum(lengths, window)[self.items].astype(np.int32)
        self.runs = (self.sizes - part_of[self.items] + 1).astype(np.int32)  # shingles of each window

    @staticmethod
    def _mix(columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h ^ c.astype(np.uint64)) * MULT
            h ^= h >> np.uint64(29)
        return h

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, shingle number) of every shingle in a run of word ids; 0 is a word that no item has."""
        at_all, num_all = [], []
        known = ids != 0
        for part, (mixed, keys, nums) in self.tables.items():
            m = len(ids) - part + 1
            if m <= 0:
                continue
            full = known[:m].copy()
            for i in range(1, part):
                full &= known[i : m + i]
            at = np.flatnonzero(full)
            if not len(at):
                continue
            h = self._mix([ids[at + i] for i in range(part)])
            lo = np.searchsorted(mixed, h)
            hit = lo < len(mixed)
            hit[hit] &= mixed[lo[hit]] == h[hit]
            at, lo = at[hit], lo[hit]
            same = (keys[lo] == np.stack([ids[at + i] for i in range(part)], axis=1)).all(axis=1) if len(at) else np.zeros(0, bool)
            while not same.all():  # equal mixes of unlike shingles: look one on
                lo = np.where(same, lo, lo + 1)
                stay = same | ((lo < len(mixed)) & (mixed[np.minimum(lo, len(mixed) - 1)] == self._mix([ids[at + i] for i in range(part)])))
                at, lo = at[stay], lo[stay]
                same = (keys[lo] == np.stack([ids[at + i] for i in range(part)], axis=1)).all(axis=1) if len(at) else np.zeros(0, bool)
            at_all.append(at)
            num_all.append(nums[lo])
        if not at_all:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, num = np.concatenate(at_all), np.concatenate(num_all)
        order = np.argsort(at, kind="stable")
        return at[order], num[order]

    def prefixes(self, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows in the order of their rarest shingle (by frequency, then number), where it stands in them, and where each
        shingle's windows begin."""
        best, offset = np.full(len(self.starts), np.iinfo(np.int64).max), np.zeros(len(self.starts), np.int32)
        rank = np.empty(self.n, np.int64)
        rank[np.lexsort((np.arange(self.n), frequency))] = np.arange(self.n)
        for i in range(int(self.runs.max(initial=0))):
            some = np.flatnonzero(self.runs > i)
            own = rank[self.number[self.starts[some] + i]]
            less = own < best[some]
            best[some[less]], offset[some[less]] = own[less], i
        rarest = self.number[self.starts + offset]
        order = np.argsort(rarest, kind="stable").astype(np.int32)
        return order, offset[order], np.searchsorted(rarest[order], np.arange(self.n + 1)).astype(np.int32)

    def join(self, prefixes: tuple[np.ndarray, np.ndarray, np.ndarray], n_words: int, at: np.ndarray, num: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words that occurring windows cover, and the items that they are of."""
        order, offset, begin = prefixes
        hits = np.flatnonzero(begin[num + 1] > begin[num])
        if not len(hits):
            return [], set()
        spans, items, there = set(), set(), set(zip(at.tolist(), num.tolist()))
        for p, k in zip(at[hits].tolist(), num[hits].tolist()):
            for j in range(begin[k], begin[k + 1]):
                w = order[j]
                start, size, first = p - int(offset[j]), int(self.sizes[w]), int(self.starts[w])
                if start < 0 or start + size > n_words:
                    continue
                if all((start + i, s) in there for i, s in enumerate(self.number[first : first + int(self.runs[w])].tolist())):
                    spans.add((start, start + size))
                    items.add(int(self.items[w]))
        return sorted(spans), items


def _sparse(rows: DataFrame, items) -> DataFrame:
    """(row, n_words, at, num) of rows (row, text): where each has shingles of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Items = items.value
        for b in batches:
            for first in range(0, b.num_rows, 500):
                part = b.slice(first, 500)
                n, at, num = _batch(block, part.column(1).to_pylist())
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(num, pa.list_(pa.int32()))], ["row", "n_words", "at", "num"])

    return rows.select("row", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "row long, n_words long, at array<int>, num array<int>")


def _batch(block: Items, texts: list[bytes | None]) -> tuple[list[int], list, list]:
    stream: list[bytes] = []
    sizes = []
    for t in texts:
        own = words_of(t)
        sizes.append(len(own))
        stream += own
        stream.append(b"")  # no word; parts the documents
    ids = np.fromiter(map(block.vocab.get, stream, repeat(0)), np.int64, len(stream))
    starts = np.cumsum([0, *(s + 1 for s in sizes)])
    at, num = block.places(ids)
    cut = np.searchsorted(at, starts)
    return sizes, [at[cut[i] : cut[i + 1]] - starts[i] for i in range(len(sizes))], [num[cut[i] : cut[i + 1]] for i in range(len(sizes))]


def _named(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def _block_count(benchmark: DataFrame, block_bytes: int) -> int:
    """Blocks of about block_bytes of text, whose size is measured before anything is fetched."""
    total = _named(benchmark).agg(F.sum(F.length("text") + F.length("name"))).first()[0] or 0
    return max(1, -(-int(total) // block_bytes))


def _blocks(benchmark: DataFrame, n: int) -> Iterator[list[tuple[str, bytes]]]:
    for k in range(n):
        own = _named(benchmark).where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k)
        yield sorted((r.name, bytes(r.text)) for r in own.toLocalIterator())


def _frequency(sparse: DataFrame, n: int) -> np.ndarray:
    """Documents per shingle of the block; at most as many rows as the block has shingles come back."""
    out = np.zeros(n, np.int64)
    if n:
        got = sparse.select(F.explode(F.array_distinct("num")).alias("num")).groupBy("num").agg(F.count("*").alias("n")).toArrow()
        out[got["num"].to_numpy()] = got["n"].to_numpy()
    return out


def _lists(b: pa.RecordBatch, column: int) -> list[np.ndarray]:
    flat, at = b.column(column).values.to_numpy(), b.column(column).offsets.to_numpy()
    return [flat[i:j] for i, j in zip(at[:-1], at[1:])]


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, shingle: int, block_bytes: int) -> DataFrame:
    """SUMMARY of each row of docs."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "decontam")
    rows = docs.select(doc_id().alias("row"), "text")
    blocks = _block_count(benchmark, block_bytes)
    if blocks > 1:
        docs = scratch.keep(docs.select(doc_id().alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id()))
        rows = docs.select("row", "text")
    found = []
    for items in _blocks(benchmark, blocks):
        block = Items(items, window, shingle)
        known = spark.sparkContext.broadcast(block)
        sparse = scratch.keep(_sparse(rows, known))
        prefixes = spark.sparkContext.broadcast(block.prefixes(_frequency(sparse, block.n)))

        def run(batches: Iterator[pa.RecordBatch], known=known, prefixes=prefixes) -> Iterator[pa.RecordBatch]:
            block, table_ = known.value, prefixes.value
            for b in batches:
                spans, items = [], []
                for n, at, num in zip(b.column(1).to_pylist(), _lists(b, 2), _lists(b, 3)):
                    s, own = block.join(table_, n, at, num) if len(at) else ((), ())
                    spans.append([x for pair in s for x in pair])
                    items.append([block.names[i] for i in own])
                yield pa.record_batch([b.column(0), b.column(1), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["row", "n_words", "spans", "items"])

        found.append(sparse.mapInArrow(run, "row long, n_words long, spans array<long>, items array<string>"))
    if len(found) == 1:
        return found[0].mapInArrow(_summary, SUMMARY)
    every = found[0].select("row", "n_words", "spans", "items")
    for f in found[1:]:  # rows without a span say nothing new
        every = every.unionAll(f.where(F.size("spans") > 0))
    every = every.groupBy("row").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return every.join(docs.select("row", "doc_id"), "row").select("doc_id", "n_words", "spans", "items").mapInArrow(_summary, SUMMARY)


SUMMARY = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hit, n_items, digest = [], [], []
        for spans, items in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            end = n = 0
            for s, e in sorted(zip(spans[::2], spans[1::2])):
                n += max(0, e - max(s, end))
                end = max(end, e)
            items = set(items)  # rows of one item_id are one item
            hit.append(n)
            n_items.append(len(items))
            digest.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
        columns = [b.column(0), b.column(1), pa.array(hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), pa.array([n > 0 for n in hit], pa.bool_())]
        yield pa.record_batch(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per document."""
    return _hits(docs, benchmark, window, shingle, block_bytes)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = 4 << 20) -> DataFrame:
    """The documents in which no window occurs, with all their columns. Needs frequencies first, so it reads the texts twice."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "decontam")
    kept, names, text = hide(docs)
    for items in _blocks(benchmark, _block_count(benchmark, block_bytes)):
        block = Items(items, window, shingle)
        known = spark.sparkContext.broadcast(block)
        sparse = scratch.keep(_sparse(kept.select(F.lit(None).cast("long").alias("row"), F.col(text).alias("text")), known).where(F.size("num") > 0))
        prefixes = spark.sparkContext.broadcast(block.prefixes(_frequency(sparse, block.n)))

        def run(batches: Iterator[pa.RecordBatch], known=known, prefixes=prefixes) -> Iterator[pa.RecordBatch]:
            block, table_ = known.value, prefixes.value
            for b in batches:
                for first in range(0, b.num_rows, 500):
                    part = b.slice(first, 500)
                    n, at, num = _batch(block, part.column(part.num_columns - 1).to_pylist())
                    good = [not (len(a) and block.join(table_, m, a, k)[0]) for m, a, k in zip(n, at, num)]
                    yield part.select(range(part.num_columns - 1)).filter(pa.array(good, pa.bool_()))

        kept = kept.withColumn("bytes", F.col(text).cast("string").cast("binary")).mapInArrow(run, kept.schema)
    return show(kept, names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(corpus(spark, sf_dir), table(spark, sf_dir, "benchmark"))


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
SQL = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS size FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sized)),
words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM words CROSS JOIN (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
found AS (SELECT doc_id, i, size, item_id FROM places JOIN windows USING (size, win)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT words.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
