"""Line dedup: sharded cuckoo filters in front of exact reference-count tables.

A line's key is the line without blanks at its ends, A-Z lower-cased; its 128-bit hash stands for it. The ledger holds,
in exact tables, which keys every document has (doc_keys) and in how many documents each key occurs (counts). The keys
of enough documents (the hot keys) also stand in cuckoo filters, one per shard of the hash space, which support insert
and delete. A line is tested against its shard's filter and, only if that says "maybe", against the exact table, so no
false positive removes a line. update() adds and takes away documents: counts change by the difference and a filter shard
is touched only by keys that cross the threshold, which makes every removal reversible.

Filters and hot keys are broadcast while their size, known before, is at most `broadcast_bytes`. Beyond it, the documents' keys
meet the filter of their shard in a shuffle: a shard's keys are dealt over as many tasks as their number asks for, each with a copy of
the filter, and what passes meets the exact table. clean() makes the tables for one corpus; LineLedger keeps them, and its clean() uses
them for any documents.

Cases: null or empty text is one empty line; keys shorter than min_chars never count and always stay; a document is a
row, so rows that repeat a doc_id count one by one; a null doc_id is an id like another; an empty table gives an empty
result; other columns are untouched, but for those named n_lines, n_dropped or kept, which give way in clean().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.llm.common import LOWER, Scratch, corpus, hide, join_spread, show

BLANKS = b" \t\n\x0b\x0c\r"
SLOTS = 4
SHARD_KEYS = 1 << 15
KICKS = 500
PROBES = 1 << 20  # keys that meet a filter in one task
SLICE = 200  # rows whose lines are in a worker's memory at once


class CuckooFilter:
    """16-bit fingerprints in buckets of four; both buckets of a key follow from one of them and the fingerprint."""

    def __init__(self, n: int):
        self.size = 1 << max(1, int(np.ceil(np.log2(max(2, n / SLOTS / 0.84)))))
        self.cells = np.zeros((self.size, SLOTS), np.uint16)

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        return (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)

    def places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (lo.view(np.uint64) & np.uint64(0xFFFF)).astype(np.uint16)
        mark = np.where(mark == 0, np.uint16(1), mark)
        one = ((lo.view(np.uint64) >> np.uint64(16)) & np.uint64(self.size - 1)).astype(np.int64)
        return mark, one, one ^ (self._mix(mark) & np.uint64(self.size - 1)).astype(np.int64)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(hi, lo)
        return ((self.cells[one] == mark[:, None]) | (self.cells[two] == mark[:, None])).any(axis=1)

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """False if some key found no place: the caller builds a larger filter from the exact table."""
        turn = 0
        for mark, one, two in zip(*(x.tolist() for x in self.places(hi, lo))):
            at = one if (self.cells[one] == 0).any() else two
            for _ in range(KICKS):
                free = np.flatnonzero(self.cells[at] == 0)
                if len(free):
                    self.cells[at, free[0]] = mark
                    break
                turn = (turn + 1) % SLOTS
                self.cells[at, turn], mark = mark, int(self.cells[at, turn])
                at ^= int(self._mix(np.array([mark]))[0]) & (self.size - 1)
            else:
                return False
        return True

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Only for keys that were inserted."""
        for mark, one, two in zip(*(x.tolist() for x in self.places(hi, lo))):
            for at in (one, two):
                if len(there := np.flatnonzero(self.cells[at] == mark)):
                    self.cells[at, there[0]] = 0
                    break

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray) -> CuckooFilter:
        n = len(hi)
        while not (f := cls(n)).insert(hi, lo):
            n = 2 * max(n, f.size)
        return f

    def dump(self) -> bytes:
        return self.cells.tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        f = cls.__new__(cls)
        f.cells = np.frombuffer(bytearray(data), np.uint16).reshape(-1, SLOTS)
        f.size = len(f.cells)
        return f


def line_keys(text: bytes | None) -> list[bytes]:
    return [x.strip(BLANKS) for x in (text or b"").translate(LOWER).split(b"\n")]


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">i8").astype(np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def _bytes(text: str = "text"):
    return F.col(text).cast("string").cast("binary")


def doc_keys(docs: DataFrame, min_chars: int = 1, with_id: bool = True, text: str = "text") -> DataFrame:
    """(doc_id, hi, lo): every document's distinct keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, SLICE):
                part = b.slice(first, SLICE)
                keys: list[bytes] = []
                sizes = []
                for t in part.column(part.num_columns - 1).to_pylist():
                    own = {k for k in line_keys(t) if _long_enough(k, min_chars)}
                    keys += own
                    sizes.append(len(own))
                hi, lo = _hashes(keys)
                at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                columns = [part.column(0).take(at)] * with_id + [pa.array(hi), pa.array(lo)]
                yield pa.record_batch(columns, ["doc_id"] * with_id + ["hi", "lo"])

    own = [F.col("doc_id").cast("long").alias("doc_id")] * with_id
    return docs.select(*own, _bytes(text).alias("text")).mapInArrow(run, "doc_id long, " * with_id + "hi long, lo long")


def counts(keys: DataFrame) -> DataFrame:
    return keys.groupBy("hi", "lo").agg(F.count("*").alias("n"))


def _shard(shards: int):
    return F.pmod(F.col("hi"), F.lit(shards)).cast("int")


def filters(hot: DataFrame, shards: int) -> DataFrame:
    """(shard, cells): a cuckoo filter for each shard that has keys. A shard has about SHARD_KEYS keys, whatever the corpus."""

    def build(key, t):
        f = CuckooFilter.of(t["hi"].to_numpy(), t["lo"].to_numpy())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([f.dump()], pa.binary())})

    return hot.select(_shard(shards).alias("shard"), "hi", "lo").groupBy("shard").applyInArrow(build, "shard int, cells binary")


class HotKeys:
    """The hot keys on an executor: filters first, the exact sorted table only for their hits."""

    def __init__(self, shards: int, cells: dict[int, bytes], hi: np.ndarray, lo: np.ndarray):
        self.shards, self.filters = shards, {k: CuckooFilter.load(v) for k, v in cells.items()}
        order = np.lexsort((lo, hi))
        self.exact = np.stack([hi[order], lo[order]], axis=1).astype(">i8").view("V16").ravel()
        self.keys = set(self.exact.tolist()) if len(order) <= 1 << 16 else None

    def __call__(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        found, shard = np.zeros(len(hi), bool), np.mod(hi, self.shards)
        for k, f in self.filters.items():
            at = np.flatnonzero(shard == k) if self.shards > 1 else np.arange(len(hi))
            if len(at):
                found[at] = f.contains(hi[at], lo[at])
        at = np.flatnonzero(found)
        if len(at):
            asked = np.stack([hi[at], lo[at]], axis=1).astype(">i8").view("V16").ravel()
            if self.keys is not None:
                found[at] = [x in self.keys for x in asked.tolist()]
            else:
                lo_bound = np.searchsorted(self.exact.view("S16"), asked.view("S16"))  # by bytes
                found[at] = self.exact[np.minimum(lo_bound, len(self.exact) - 1)] == asked
        return found


def _clean(text: bytes | None, hot, min_chars: int) -> tuple[int, int, bytes]:
    """Lines, dropped lines, what is left."""
    text = text or b""
    keys = line_keys(text)
    ask = [i for i, k in enumerate(keys) if _long_enough(k, min_chars)]
    gone = set()
    if ask:
        hi, lo = _hashes([keys[i] for i in ask])
        gone = {ask[i] for i in np.flatnonzero(hot(hi, lo)).tolist()}
    return len(keys), len(gone), b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in gone) if gone else text


OUT = "n_lines long, n_dropped long, kept string"


def _marked(hidden: DataFrame, text: str, hot: DataFrame, cells: DataFrame, shards: int, min_chars: int, broadcast_bytes: int, scratch: Scratch) -> DataFrame:
    """hidden with n_lines, n_dropped and kept, for kept tables hot (hi, lo, n) and cells (shard, cells)."""
    spark, n = hidden.sparkSession, hot.count()
    if n * 40 <= broadcast_bytes:
        filled = {r.shard: bytes(r.cells) for r in cells.where("cells is not null").collect()} if n else {}
        exact = hot.select("hi", "lo").toArrow()
        known = spark.sparkContext.broadcast((shards, filled, exact["hi"].to_numpy(), exact["lo"].to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            test = HotKeys(*known.value)
            for b in batches:
                for at in range(0, b.num_rows, SLICE):
                    part = b.slice(at, SLICE)
                    yield _rows(part, [_clean(t, test, min_chars) for t in part.column(part.num_columns - 1).to_pylist()])

        given = hidden.withColumn("bytes", _bytes(text))
        return given.mapInArrow(run, T.StructType([*hidden.schema.fields, *T._parse_datatype_string(OUT).fields]))
    numbered = scratch.keep(hidden.withColumn("row", F.monotonically_increasing_id()))
    probes = scratch.keep(doc_keys(numbered.withColumn("doc_id", F.col("row")), min_chars, text=text).withColumn("shard", _shard(shards)))
    parts = F.broadcast(probes.groupBy("shard").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("parts")))  # 12 bytes for each SHARD_KEYS hot keys
    asked = probes.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    copies = cells.where("cells is not null").join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "cells")
    maybe = asked.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(_probe, "doc_id long, hi long, lo long")
    found = join_spread(maybe, hot, ["hi", "lo"])
    per_doc = found.groupBy(F.col("doc_id").alias("row")).agg(F.collect_list(F.struct("hi", "lo")).alias("hot"))  # a document's own lines at most
    joined = numbered.join(per_doc, "row", "left").drop("row").withColumn("bytes", _bytes(text))

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                rows = []
                for t, own in zip(part.column(part.num_columns - 1).to_pylist(), part.column(part.num_columns - 2).to_pylist()):
                    have = {(x["hi"], x["lo"]) for x in own or ()}
                    rows.append(_clean(t, lambda hi, lo: np.array([x in have for x in zip(hi.tolist(), lo.tolist())], bool), min_chars))  # noqa: B023
                yield _rows(part.select([*range(part.num_columns - 2), part.num_columns - 1]), rows)

    return joined.mapInArrow(apart, T.StructType([*hidden.schema.fields, *T._parse_datatype_string(OUT).fields]))


def _tables(docs: DataFrame, text: str, min_docs: int, min_chars: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """The hot keys (hi, lo, n), their filters (shard, cells) and the number of shards."""
    hot = scratch.keep(counts(doc_keys(docs, min_chars, with_id=False, text=text)).where(F.col("n") >= min_docs))
    shards = max(1, -(-hot.count() // SHARD_KEYS))
    return hot, scratch.keep(filters(hot, shards)), shards


def clean(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """All columns of docs, and n_lines, n_dropped, kept (the text without the lines whose key min_docs rows have)."""
    hidden, names, text = hide(docs)
    scratch = Scratch(docs.sparkSession, "lines")
    marked = _marked(hidden, text, *_tables(hidden, text, min_docs, min_chars, scratch), min_chars, broadcast_bytes, scratch)
    return show(marked, names, "n_lines", "n_dropped", "kept")


def rewrite(docs: DataFrame, n_chars: str | None = None, min_docs: int = 10, min_chars: int = 1, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """docs, of the same columns, with text cut to the lines that stay (null stays null); n_chars names a column that follows its length."""
    hidden, names, text = hide(docs)
    scratch = Scratch(docs.sparkSession, "lines")
    marked = _marked(hidden, text, *_tables(hidden, text, min_docs, min_chars, scratch), min_chars, broadcast_bytes, scratch)
    new = {text: F.when(F.col(text).isNotNull(), F.col("kept"))}
    if n_chars and n_chars.lower() in (lower := [n.lower() for n in names]):
        at = f"c{lower.index(n_chars.lower())}"
        new[at] = F.length("kept").cast(hidden.schema[at].dataType)
    return show(marked, names, **new)


def _probe(probes, cells):
    if not (cells.num_rows and probes.num_rows):
        return probes.select(["doc_id", "hi", "lo"]).slice(0, 0)
    f = CuckooFilter.load(cells["cells"][0].as_py())
    return probes.select(["doc_id", "hi", "lo"]).filter(pa.chunked_array([pa.array(f.contains(probes["hi"].to_numpy(), probes["lo"].to_numpy()))]))


def _rows(b: pa.RecordBatch, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    n, gone, kept = zip(*rows) if rows else ((), (), ())
    columns = [*b.columns[:-1], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
    return pa.record_batch(columns, [*b.schema.names[:-1], "n_lines", "n_dropped", "kept"])


class LineLedger:
    """Incremental form: tables doc_keys and counts, filters by shard; update() gives the ledger after a change."""

    def __init__(self, spark: SparkSession, keys: DataFrame, count: DataFrame, cells: DataFrame, shards: int, min_docs: int, min_chars: int):
        self.spark, self.keys, self.counts, self.cells, self.shards, self.min_docs, self.min_chars = spark, keys, count, cells, shards, min_docs, min_chars

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> LineLedger:
        s = Scratch(docs.sparkSession, "ledger")
        keys = s.keep(doc_keys(docs, min_chars))
        count = s.keep(counts(keys))
        hot = count.where(F.col("n") >= min_docs)
        shards = max(1, -(-hot.count() // SHARD_KEYS))
        return cls(docs.sparkSession, keys, count, s.keep(filters(hot, shards)), shards, min_docs, min_chars)

    def update(self, added: DataFrame | None = None, removed_ids: DataFrame | None = None) -> LineLedger:
        """The ledger with the documents added and those of removed_ids (doc_id) gone; the inverse call restores it."""
        s = Scratch(self.spark, "ledger")
        more = doc_keys(added, self.min_chars) if added is not None else self.keys.limit(0)
        ids = (removed_ids if removed_ids is not None else self.keys.limit(0)).select(F.col("doc_id").cast("long").alias("gone")).distinct()
        same = self.keys["doc_id"].eqNullSafe(F.col("gone"))
        less = self.keys.join(ids, same, "left_semi")
        delta = more.select("hi", "lo", F.lit(1).alias("d")).unionAll(less.select("hi", "lo", F.lit(-1).alias("d"))).groupBy("hi", "lo").agg(F.sum("d").alias("d"))
        new = s.keep(self.counts.join(delta, ["hi", "lo"], "full").select("hi", "lo", F.coalesce("n", F.lit(0)).alias("was"), (F.coalesce("n", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("n")))
        m = self.min_docs
        crossed = new.select("hi", "lo", F.when((F.col("was") < m) & (F.col("n") >= m), 1).when((F.col("was") >= m) & (F.col("n") < m), -1).alias("d")).where("d is not null")
        shards = self.shards

        def patch(key, cells, change):
            hi, lo, d = (change[c].to_numpy() for c in ("hi", "lo", "d"))
            f = CuckooFilter.load(cells["cells"][0].as_py()) if cells.num_rows else CuckooFilter(len(hi))
            f.delete(hi[d < 0], lo[d < 0])
            ok = f.insert(hi[d > 0], lo[d > 0])
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([f.dump() if ok else None], pa.binary())})

        cells = self.cells.groupBy("shard").cogroup(crossed.withColumn("shard", _shard(shards)).groupBy("shard")).applyInArrow(patch, "shard int, cells binary")
        cells = s.keep(cells)
        left = new.where("n > 0").select("hi", "lo", "n")
        if cells.where("cells is null").count():  # a shard ran full: new filters from the exact table
            cells = s.keep(filters(left.where(F.col("n") >= m), shards))
        keys = s.keep(self.keys.join(ids, same, "left_anti").unionAll(more))
        return LineLedger(self.spark, keys, s.keep(left), cells, shards, m, self.min_chars)

    def clean(self, docs: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
        """As clean(), by the counts and filters of the ledger instead of the documents' own."""
        hidden, names, text = hide(docs)
        s = Scratch(self.spark, "lines")
        hot = s.keep(self.counts.where(F.col("n") >= self.min_docs))
        return show(_marked(hidden, text, hot, self.cells, self.shards, self.min_chars, broadcast_bytes, s), names, "n_lines", "n_dropped", "kept")


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """The digest: doc_id, n_lines, n_dropped, kept_sha256."""
    return clean(docs.select("doc_id", "text"), **options).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(corpus(spark, sf_dir))


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
lines AS (SELECT d, doc_id, unnest(a) AS line, unnest(range(len(a))) AS i FROM docs),
keyed AS (SELECT d, doc_id, i, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_BLANKS}) AS k FROM lines),
hot AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT d) >= 10),
marked AS (SELECT keyed.*, hot.k IS NOT NULL AS gone FROM keyed LEFT JOIN hot USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY d, doc_id
"""
