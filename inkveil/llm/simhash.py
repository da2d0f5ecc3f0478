"""SimHash near-dedup by bit-sliced comparison.

Fingerprints are the majority bits of the XXH64 values of a text's word shingles. Documents link when their
fingerprints differ in at most `radius` bits. Search runs over distinct fingerprints only:

* A fingerprint's 8 bytes give C(8, radius) keys, each with `radius` bytes left out. Two fingerprints within the
  radius share a key, and a key's bucket has at most 2**(8 * radius) members, however skewed the corpus is.
* A bucket is compared in bit-sliced form: bit b of all lanes is one vertical plane, XORs of planes feed carry-save
  counters that count many distances at once, and a block of lanes is abandoned once every lane is over the radius.
* Links become stars within a bucket (never all pairs), and the stars become components.

Near copies of a corpus (keep_one) are decided on exact sets of shingles: SimHashes of 512 bits propose them. Groups of any size are
dealt over tasks: members meet the first of their bucket, then only members that are not yet joined meet, block by block.

Cases: null, empty or blank text has fingerprint 0 and links like any other; a null doc_id comes after all others, so a group of
rows without any has the component null; rows that repeat a doc_id are rows of their own, each with its own group; an empty table
gives an empty result; columns other than doc_id and text are ignored (keep_one keeps them, whatever their names).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.llm.common import LOWER, Scratch, components, corpus, doc_id, hide, join_spread, show

SEED = 42
CHUNK = 1 << 16
LANES = 64
LARGE = 16  # buckets of more members are compared word by word
BLOCKS = 1 << 13  # blocks of lanes at once: 64 KB for each plane of a counter


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text."""
    words = (text or b"").translate(LOWER).split()  # bytes.split() parts at exactly 09-0D and 20
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - width + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(width)))), repeat(SEED)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(id, fp): the document's id, and its fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                fps = [_signed(fingerprint(t, width)) for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    return docs.select(doc_id().alias("id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "id long, fp long")


def _planes(values: np.ndarray) -> np.ndarray:
    """Vertical planes of fingerprints (lane, word): row i has bit i of every lane, packed into 64-bit words."""
    lanes = np.unpackbits(np.ascontiguousarray(values, "<u8").view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.pad(lanes, ((0, -len(values) % 64), (0, 0))).T.copy(), axis=1).view(np.uint64)


def within(values: np.ndarray, others: np.ndarray, radius: int, block: int = 1 << 12) -> np.ndarray:
    """Lane by lane, do fingerprints (lane, word) differ in at most radius bits? Carry-save counters saturate above it."""
    out = np.empty(len(values), bool)
    width = int(radius + 1).bit_length()
    for at in range(0, len(values), block):
        diff = _planes(values[at : at + block] ^ others[at : at + block])
        counts, over = np.zeros((width, diff.shape[1]), np.uint64), np.zeros(diff.shape[1], np.uint64)
        n = min(block, len(values) - at)
        live = np.packbits(np.pad(np.ones(n, np.uint8), (0, -n % 64))).view(np.uint64)
        for i, carry in enumerate(diff):
            for c in counts:  # half adders: the carry moves up a plane
                c ^= carry
                carry = carry & ~c
                if not carry.any():
                    break
            else:
                over |= carry
            if i >= radius and (i % 16 == 15 or i + 1 == len(diff)):
                over |= _above(counts, radius)
                if not (live & ~over).any():  # every lane of the block is beyond the radius: abandoned
                    break
        out[at : at + n] = np.unpackbits((~over).view(np.uint8))[:n]
    return out


def _above(counts: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is over radius, by comparing from the highest plane down."""
    more, same = np.zeros_like(counts[0]), ~np.zeros_like(counts[0])
    for i in reversed(range(len(counts))):
        if radius >> i & 1:
            same &= counts[i]
        else:
            more |= same & counts[i]
            same &= ~counts[i]
    return more


def _first_alike(sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each member of buckets laid end to end, the place of the first of its bucket with the same id."""
    order = np.lexsort((np.arange(len(ids)), ids, bucket := np.repeat(np.arange(len(sizes)), sizes)))
    new = np.r_[True, (np.diff(ids[order]) != 0) | (np.diff(bucket[order]) != 0)][: len(ids)]
    out = np.empty(len(ids), np.int64)
    out[order] = order[new][np.cumsum(new) - 1] if len(ids) else 0
    return out


def _links_of(ids: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unlike = np.flatnonzero(ids != ids[label])
    return ids[unlike], ids[label[unlike]]


def _stars(sizes: np.ndarray, ids: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between ids of the same bucket (members with the same id are joined from the start): in round r each member meets the
    one r places on, unless they are joined already."""
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    ends = first + np.repeat(sizes, sizes)
    label = _first_alike(sizes, ids)
    at, r = np.arange(len(ids)), 1
    while True:
        at = at[at + r < ends[at]]
        if r & (r - 1) == 0:  # members of wholly joined buckets are done
            whole = np.minimum.reduceat(label == first, first[sizes.cumsum() - sizes]) if len(sizes) else np.zeros(0, bool)
            at = at[~np.repeat(whole, sizes)[at]]
        if not len(at):
            break
        ask = at[label[at] != label[at + r]]
        near = ask[within(fps[ask], fps[ask + r], radius)] if len(ask) else ask
        for i, j in zip(near.tolist(), (near + r).tolist()):
            while label[i] != i:
                label[i] = label[label[i]]
                i = label[i]
            while label[j] != j:
                label[j] = label[label[j]]
                j = label[j]
            if i != j:
                label[max(i, j)] = min(i, j)
        while len(near) and (label != label[label]).any():
            label = label[label]
        r += 1
    return _links_of(ids, label)


def _near_lanes(planes: np.ndarray, flips: np.ndarray, query: np.ndarray, word: np.ndarray, live: np.ndarray, radius: int) -> np.ndarray:
    """The lanes among `live` within the radius of their query, for blocks of 64 lanes (planes[:, word]) each met by one query.

    flips (bit, query) has all bits set where the query has the bit. Blocks without a lane in reach are abandoned on the way."""
    out, at = np.zeros(len(word), np.uint64), np.arange(len(word))
    counts, over = np.zeros((int(radius + 1).bit_length(), len(word)), np.uint64), ~live
    for i in range(len(planes)):
        carry = planes[i][word] ^ flips[i][query]
        for c in counts:
            c ^= carry
            carry = carry & ~c
            if not carry.any():
                break
        else:
            over |= carry
        if i >= radius and i % 16 == 15:
            stay = np.flatnonzero(~(over | _above(counts, radius)))
            if len(stay) < len(at) // 2:
                at, query, word, over, counts = at[stay], query[stay], word[stay], over[stay], counts[:, stay]
                if not len(at):
                    return out
    out[at] = ~(over | _above(counts, radius))
    return out


def _large_stars(sizes: np.ndarray, ids: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """As _stars, for buckets of many members: planes are made once, and a member meets 64 others of its bucket in a word.

    Only members that are not joined to it already count as lanes in question, and wholly joined buckets are done."""
    n_words = -(-sizes // LANES)
    first = np.repeat((np.cumsum(n_words) - n_words) * LANES - np.cumsum(sizes) + sizes, sizes) + np.arange(len(ids))
    padded = np.zeros((int(n_words.sum()) * LANES, fps.shape[1]), np.uint64)
    padded[first] = fps
    bucket, there = np.repeat(np.arange(len(sizes)), sizes), np.zeros(len(padded), bool)
    there[first] = True
    begin = (np.cumsum(n_words) - n_words).astype(np.int64)
    planes, label, same = _planes(padded), np.arange(len(padded)), _first_alike(sizes, ids)
    label[first] = first[same]
    parts = np.bincount(bucket[same == np.arange(len(ids))], minlength=len(sizes))
    order = np.lexsort((bucket, first - begin[bucket] * LANES))  # first members of all buckets first
    lane, bucket = first[order], bucket[order]
    cost = np.cumsum(n_words[bucket] - (lane // LANES - begin[bucket]))
    cuts = np.unique(np.concatenate([[0], np.searchsorted(cost, np.arange(BLOCKS, int(cost[-1]) if len(cost) else 0, BLOCKS), side="right"), [len(lane)]]))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        q = lane[lo:hi][parts[bucket[lo:hi]] > 1]
        b = bucket[lo:hi][parts[bucket[lo:hi]] > 1]
        if not len(q):
            continue
        n = begin[b] + n_words[b] - q // LANES
        query = np.repeat(np.arange(len(q)), n)
        word = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(q // LANES, n)
        lanes = word[:, None] * LANES + np.arange(LANES)
        mine = q[query][:, None]
        live = np.packbits(there[lanes] & (lanes > mine) & (label[lanes] != label[mine]), axis=1).view(np.uint64).ravel()
        some = np.flatnonzero(live)
        query, word = query[some], word[some]
        flips = np.where(np.unpackbits(padded[q].view(np.uint8), axis=1, bitorder="little").T, ~np.uint64(0), np.uint64(0))
        near = _near_lanes(planes, flips, query, word, live[some], radius)
        hit = np.flatnonzero(near)
        if not len(hit):
            continue
        row, at = np.nonzero(np.unpackbits(near[hit].view(np.uint8).reshape(-1, 8), axis=1))
        row, at = query[hit[row]], word[hit[row]] * LANES + at
        ends = np.flatnonzero(np.r_[np.diff(row) > 0, True]) + 1
        for i, j in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()):
            own = int(b[row[i]])
            span = slice(int(begin[own]) * LANES, int(begin[own] + n_words[own]) * LANES)
            joined = np.unique(np.r_[label[q[row[i]]], label[at[i:j]]])
            if len(joined) > 1:
                to = np.arange(span.start, span.stop)
                to[joined - span.start] = joined[0]
                label[span] = to[label[span] - span.start]
                parts[own] -= len(joined) - 1
    place = np.zeros(len(padded), np.int64)
    place[first] = np.arange(len(ids))
    return _links_of(ids, place[label[first]])


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) that join all fingerprints (fp) within the radius, directly or through others of their bucket."""
    keys = []
    for t, gone in enumerate(combinations(range(8), radius)):
        mask = _signed(~sum(0xFF << 8 * g for g in gone) & (1 << 64) - 1)
        keys.append(F.struct(F.lit(t).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")))
    return _bucket_links(distinct.select(F.col("fp").alias("id"), F.array("fp").alias("fp"), F.explode(F.array(*keys)).alias("k")), ["k"], radius)


def _bucket_links(keyed: DataFrame, by: list[str], radius: int) -> DataFrame:
    """(a, b) for rows (id, fp array<long>, and the columns `by` of a bucket of bounded size): bit-sliced comparison inside every
    bucket, whose links between unlike ids leave as stars."""
    buckets = keyed.groupBy(*by).agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("fp")).alias("fps")).where(F.size("ids") > 1).select("ids", "fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fps = b.column(0), b.column(1)
            sizes, begin = np.diff(ids.offsets.to_numpy()), ids.offsets.to_numpy()[:-1] - ids.offsets.to_numpy()[0]
            order = np.argsort(-sizes, kind="stable")  # buckets of one size meet in the same rounds
            sizes = sizes[order]
            at = np.repeat(begin[order], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            bits = fps.flatten().to_numpy().view(np.uint64).reshape(len(ids.flatten()), -1)
            own, large = ids.flatten().to_numpy()[at], int((sizes > LARGE).sum())  # sizes descend
            cut = int(sizes[:large].sum())
            both = _large_stars(sizes[:large], own[:cut], bits[at[:cut]], radius), _stars(sizes[large:], own[cut:], bits[at[cut:]], radius)
            a, z = (np.concatenate(x) for x in zip(*both))
            pairs = np.unique(np.stack([np.maximum(a, z), np.minimum(a, z)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
            yield pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return buckets.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component, grp): a row per document; component is the smallest id reachable over links, grp the smallest fingerprint.

    Groups are formed over fingerprints, so unlike ones whose smallest id is the same (or null) stay groups of their own."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep(fingerprints(docs, width))
    distinct = scratch.keep(fps.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    comp = components(links(distinct.select("fp"), radius), scratch)
    named = scratch.keep(distinct.join(comp.select(F.col("id").alias("fp"), "component"), "fp", "left").select("fp", "id", F.col("n").alias("rows"), F.coalesce("component", "fp").alias("grp")))
    by_group = scratch.keep(named.groupBy("grp").agg(F.min("id").alias("component"), F.count("*").alias("n")))
    by_fp = scratch.keep(join_spread(named.drop("id"), by_group, ["grp"]).withColumnRenamed("rows", "n"))
    return join_spread(fps, by_fp, ["fp"]).select("id", "fp", "component", "grp")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_groups(docs, width, radius).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


WORDS, BANDS, ROWS = 8, 16, 3
TABLE, SLICE = 1 << 20, 1 << 20  # low bits of a hash; hashes met at once
BLOCK_FPS, BLOCK_HASHES = 1 << 13, 1 << 18  # of two such blocks a task holds at once: fingerprints, hashes of sets
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mixed(h: np.ndarray, i: int) -> np.ndarray:
    """The i-th hash function of already hashed values."""
    x = (h + np.uint64(i * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * MIX[i % len(MIX)]
    return (x ^ x >> np.uint64(29)) * MIX[(i + 3) % len(MIX)]


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The sorted hashes of a text's shingles; a text of fewer words is one shingle."""
    words = (text or b"").translate(LOWER).split()
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(width)))), repeat(SEED)), np.uint64, len(words) - width + 1))


def _set_hash(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes(), 1)


def sketch(text: bytes | None, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Of the set of a text's shingles: a hash of the whole set, a 512-bit SimHash, and 16 band keys of 3 minima each."""
    h = shingle_set(text, width)
    ones = np.zeros(64 * WORDS, np.int64)
    low = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(h), 1 << 13):
        part = h[at : at + (1 << 13)]
        wide = np.stack([_mixed(part, i) for i in range(WORDS)], axis=1)
        ones += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        low = np.minimum(low, np.array([_mixed(part, WORDS + i).min() for i in range(len(low))], np.uint64))
    bands = low.reshape(BANDS, ROWS)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(bands)]
    return _set_hash(h), np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64), np.array(keys, np.uint64)


def _unlike(common: int, left: int, right: int) -> float:
    """The chance that a majority bit differs between sets of so many common shingles and so many of their own."""

    def ones(own: int) -> np.ndarray:
        """By the ones among the common shingles: the chance that the set's bit is 1."""
        odds = np.array([math.comb(own, k) for k in range(own + 1)]) / 2**own
        return np.array([odds[2 * (k + np.arange(own + 1)) > common + own].sum() for k in range(common + 1)])

    a, b = ones(left), ones(right)
    return float((np.array([math.comb(common, k) for k in range(common + 1)]) / 2**common * (a * (1 - b) + (1 - a) * b)).sum())


@lru_cache
def _radius(similarity: float, short: int = 24) -> int:
    """Bits that the fingerprints of sets of that similarity stay within: seven standard deviations over the mean of long texts, or
    over that of the worst pair of short ones, whose majority bits turn more easily."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    pairs = ((c, x, y) for c in range(1, short + 1) for y in range(short) for x in range(y + 1) if c >= similarity * (c + x + y))
    p = max([p, *(_unlike(*n) for n in pairs)])
    return min(64 * WORDS, int(64 * WORDS * p + 7 * np.sqrt(64 * WORDS * p * (1 - p))))


def exact_links(sizes: np.ndarray, hashes: np.ndarray, label: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Of sets laid end to end in hashes, links that join all pairs of the similarity or more whose labels differ, directly or through others.

    A set meets all after it that are not joined to it yet. A table of the low bits of its hashes bounds the common ones from
    above, and the pairs that it leaves are counted hash by hash."""
    begin, ends, out = np.cumsum(sizes) - sizes, np.cumsum(sizes), []
    label, table_, low = label.copy(), np.zeros(TABLE, np.uint8), (hashes & np.uint64(TABLE - 1)).astype(np.int32)
    for x in range(len(sizes) - 1):
        here = slice(int(begin[x]), int(ends[x]))
        others = x + 1 + np.flatnonzero((label[x + 1 :] != label[x]) & (sizes[x + 1 :] >= similarity * sizes[x]) & (similarity * sizes[x + 1 :] <= sizes[x]))
        if not len(others):
            continue
        table_[low[here]] = 1
        spans = np.cumsum(sizes[others])
        lo = 0
        while lo < len(others):
            base = int(spans[lo] - sizes[others[lo]])
            hi = max(lo + 1, int(np.searchsorted(spans, base + SLICE, side="right")))
            some = others[lo:hi]
            flat = np.concatenate([low[begin[i] : ends[i]] for i in some.tolist()])
            most = np.add.reduceat(table_[flat], spans[lo:hi] - sizes[some] - base, dtype=np.int64)
            most = np.minimum(most, np.minimum(sizes[some], sizes[x]))
            for y in some[most >= similarity * (sizes[some] + sizes[x] - most)].tolist():
                if label[y] != label[x] and alike(hashes[here], hashes[begin[y] : ends[y]], similarity):
                    label[label == label[y]] = label[x]
                    out.append((x, y))
            lo = hi
        table_[low[here]] = 0
    return out


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common)


def _blocks(members: DataFrame, cap: int, scratch: Scratch) -> DataFrame | None:
    """(g, t, s, label) of members (g, label, s, w): tasks (g, t) in which any two members of a group with unlike labels meet. None if
    no group has unlike labels.

    A group that weighs no more than 2 * cap is one task. A heavier one is cut into blocks of about cap, of one label each if that
    weighs more than cap and else mixed, and each pair of blocks that has unlike labels is a task. Members of one label never
    meet for their own sake, so a group that is one label but for a few members makes about as many tasks as it has blocks."""
    by_label = scratch.keep(members.groupBy("g", "label").agg(F.sum("w").alias("lw"), F.count("*").alias("n")))
    whole = by_label.groupBy("g").agg(F.sum("lw").alias("all"), F.count("*").alias("labels"), F.sum("n").alias("n")).where("labels > 1").drop("labels")
    whole = scratch.keep(whole, most=F.max("all"))
    if not whole.seen["rows"]:
        return None
    dealt = join_spread(members.select("g", "label", "s"), whole, ["g"])
    if whole.seen["most"] <= 2 * cap:
        return dealt.select("g", F.lit(0).cast("long").alias("t"), "s", "label")
    small = dealt.where(F.col("all") <= 2 * cap).select("g", F.lit(0).cast("long").alias("t"), "s", "label")
    units = scratch.keep(by_label.join(whole.where(F.col("all") > 2 * cap).select("g", "all"), "g"))
    own = F.when(F.col("lw") > cap, F.col("label"))  # null: a mixed block
    large = units.groupBy("g", own.alias("u")).agg(F.ceil(F.sum("lw") / cap).cast("int").alias("n_blocks"), F.sum("n").alias("n"))
    large = scratch.keep(large.withColumn("k", F.xxhash64("u")))
    blocks = large.select("g", "k", "u", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("b"))
    x, y = (blocks.select("g", *(F.col(c).alias(f"{c}{side}") for c in "kub")) for side in "xy")
    pairs = x.join(y, "g").where("struct(kx, bx) <= struct(ky, by) and not (ux <=> uy and ux is not null)").withColumn("t", F.xxhash64("kx", "bx", "ky", "by"))
    places = pairs.select("g", F.explode(F.array_distinct(F.array(F.struct(F.col("kx").alias("k"), F.col("bx").alias("b")), F.struct(F.col("ky").alias("k"), F.col("by").alias("b"))))).alias("p"), "t").select("g", "p.k", "p.b", "t")
    heavy = join_spread(dealt.where(F.col("all") > 2 * cap).drop("all"), units, ["g", "label"]).withColumn("k", F.xxhash64(own))
    heavy = join_spread(heavy.select("g", "k", "s", "label"), large.select("g", "k", "n_blocks", "n"), ["g", "k"], seen=large.seen).withColumn("b", F.pmod(F.xxhash64("s"), F.col("n_blocks")).cast("int"))
    return small.unionByName(heavy.join(places, ["g", "k", "b"]).select("g", "t", "s", "label"))


def _radius_links(edges: DataFrame, radius: int) -> DataFrame:
    """The edges (s, lead) of rows (s, lead, fp, lead_fp) whose fingerprints are within the radius, by bit slices of many edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = (b.column(i).flatten().to_numpy().view(np.uint64).reshape(b.num_rows, -1) for i in (2, 3))
            yield b.select(range(2)).filter(pa.array(within(one, two, radius), pa.bool_()))

    return edges.select("s", "lead", "fp", "lead_fp").mapInArrow(run, "s long, lead long")


def _sets(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(s, m, hashes): the exact sets, m hashes each, of the wanted (s, id, h). A set may be there more than once if rows repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            for at in range(0, b.num_rows, 500):
                names, sets = [], []
                for s, text in zip(*(c.to_pylist() for c in b.slice(at, 500).columns)):
                    if s != last:
                        names.append(s)
                        sets.append(shingle_set(text, width))
                        last = s
                offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                flat = pa.array(np.concatenate(sets or [np.zeros(0, np.uint64)]).view(np.int64))
                yield pa.record_batch([pa.array(names, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.ListArray.from_arrays(offsets, flat)], ["s", "m", "hashes"])

    same = texts["id"].eqNullSafe(wanted["id"]) & (texts["h"] == wanted["h"])
    return texts.join(wanted, same).select("s", "text").mapInArrow(run, "s long, m long, hashes array<long>")


def _hashes(column: pa.ListArray) -> list[np.ndarray]:
    flat, at = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(at[:-1], at[1:])]


def _verified(edges: DataFrame, sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Of edges (s, lead), those (a, b) whose exact sets are alike. A lead's many edges are dealt over tasks, each with the lead's set."""
    leads = scratch.keep(edges.groupBy("lead").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / 2000).cast("int")))
    mine = join_spread(edges, leads, ["lead"]).select("lead", F.pmod(F.xxhash64("s"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), "s")
    theirs = leads.select("lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("lead").alias("s"))
    rows = mine.unionByName(theirs).join(sets.select("s", "hashes"), "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead_set = np.zeros(0, np.uint64)
        for b in batches:
            a, z = [], []
            for lead, role, s, own in zip(*(b.column(i).to_pylist() for i in range(3)), _hashes(b.column(3))):
                if not role:
                    lead_set = own.copy()
                elif alike(lead_set, own, similarity):
                    a.append(s)
                    z.append(lead)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

    dealt = rows.repartition("lead", "part").sortWithinPartitions("lead", "part", "role", "s")
    return dealt.select("lead", "role", "s", "hashes").mapInArrow(run, "a long, b long")


def _block_links(tasks: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): labels of tasks' members (g, t, s, label) that exact sets of the similarity join."""
    rows = tasks.join(sets.select("s", "hashes"), "s").repartition("g", "t").sortWithinPartitions("g", "t", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, labels, parts = None, [], [], []

        def links_() -> pa.RecordBatch:
            at = exact_links(np.array([len(p) for p in parts]), np.concatenate(parts), np.unique(labels, return_inverse=True)[1], similarity)
            return pa.record_batch([pa.array([labels[i] for i, _ in at], pa.int64()), pa.array([labels[j] for _, j in at], pa.int64())], ["a", "b"])

        for b in batches:
            for g, t, s, label, own in zip(*(b.column(i).to_pylist() for i in range(4)), _hashes(b.column(4))):
                if names and (g, t) != now:
                    yield links_()
                    names, labels, parts = [], [], []
                now = g, t
                if not names or names[-1] != s:
                    names.append(s)
                    labels.append(label)
                    parts.append(own.copy())
        if names:
            yield links_()

    return rows.select("g", "t", "s", "label", "hashes").mapInArrow(run, "a long, b long")


def _labelled(rows: DataFrame, comp: DataFrame, col: str = "s") -> DataFrame:
    """rows with label, the component of col, or col itself where it has none."""
    return rows.join(comp.select(F.col("id").alias(col), "component"), col, "left").withColumn("label", F.coalesce("component", col)).drop("component")


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, h, component): groups over links of shingle-set similarity of `similarity` or more; h is the xxhash64 of the text, and
    component the smallest hash of a set in the group.

    Texts with the same set are one vertex, whatever their ids. Others are candidates if one of 16 bands (3 minima each) agrees, which
    two of similarity 0.8 miss once in 10**5, and their fingerprints are within _radius. In three steps, none of which holds a whole
    bucket or group in a task:

    1. Members of a bucket meet its smallest. Buckets that this does not join wholly are compared in blocks. What is joined is a cluster.
    2. The exact sets of the pairs of the first kind are compared. Clusters that this joins wholly are done, such as a text and
       its many near copies.
    3. In the others, members that are not joined yet meet in blocks, by exact sets.
    """
    scratch = Scratch(docs.sparkSession, "similar")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rows = [sketch(t, width) for t in part.column(2).to_pylist()]
                sets = pa.array(np.array([r[0] for r in rows], np.uint64).view(np.int64))
                lists = [pa.array([r[i].view(np.int64) for r in rows], pa.list_(pa.int64())) for i in (1, 2)]
                yield pa.record_batch([part.column(0), part.column(1), sets, *lists], ["id", "h", "s", "fp", "bands"])

    texts = docs.select(doc_id().alias("id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = scratch.keep(texts.mapInArrow(run, "id long, h long, s long, fp array<long>, bands array<long>"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("m")
    sets_ = scratch.keep(rows.groupBy("s").agg(first, F.first("fp").alias("fp"), F.first("bands").alias("bands")).select("s", "m.id", "m.h", "fp", "bands"))
    radius = _radius(similarity)

    keys = sets_.select("s", F.explode("bands").alias("k"))
    lead = scratch.keep(keys.groupBy("k").agg(F.min("s").alias("lead"), F.count("*").alias("n")).where("n > 1"))
    members = scratch.keep(join_spread(keys, lead, ["k"]))
    fps = sets_.select("s", "fp")
    edges = members.where("s <> lead").select("s", "lead").distinct().join(fps, "s")
    by_lead = scratch.keep(members.where("s <> lead").groupBy("lead").agg(F.count("*").alias("n")).join(fps.select(F.col("s").alias("lead"), F.col("fp").alias("lead_fp")), "lead"))
    near = scratch.keep(_radius_links(join_spread(edges, by_lead, ["lead"]), radius))
    joined = components(near.select(F.col("s").alias("a"), F.col("lead").alias("b")), scratch)
    marked = scratch.keep(_labelled(members.select("k", "s"), joined))
    scratch.drop(lead, members, by_lead)
    mixed = scratch.keep(marked.groupBy("k").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("k", "n"))
    clusters = near.select(F.col("s").alias("a"), F.col("lead").alias("b")).limit(0)
    if mixed.seen["rows"]:
        todo = scratch.keep(join_spread(marked, mixed, ["k"]).select(F.col("k").alias("g"), "label", "s", F.lit(1).alias("w")))
        tasks = _blocks(todo, BLOCK_FPS, scratch).join(fps, "s").select("g", "t", F.col("label").alias("id"), "fp")
        clusters = _bucket_links(tasks, ["g", "t"], radius)  # between labels
    clusters = components(clusters, scratch)
    scratch.drop(marked)

    ends = clusters.select(F.col("id").alias("label"), F.col("component").alias("g"))
    ends = ends.unionByName(ends.select(F.col("g").alias("label"), "g").distinct())
    linked = joined.select(F.col("id").alias("s"), F.col("component").alias("label"))
    linked = linked.unionByName(linked.select(F.col("label").alias("s"), "label").distinct())  # every s that is linked to its lead
    cluster = linked.join(ends, "label", "full").select(F.coalesce("s", "label").alias("s"), F.coalesce("g", "label").alias("g"))
    cluster = scratch.keep(cluster)
    sets = scratch.keep(_sets(texts, sets_.select("s", "id", "h").join(cluster.select("s"), "s"), width))
    scratch.drop(sets_)
    sure = scratch.keep(_verified(near, sets, similarity, scratch))
    scratch.drop(near)
    exact = components(sure, scratch)
    open_ = scratch.keep(_labelled(cluster, exact).join(sets.groupBy("s").agg(F.max("m").alias("w")), "s").select("g", "label", "s", "w"))
    tasks = _blocks(open_, BLOCK_HASHES, scratch)
    more = components(_block_links(tasks, sets, similarity) if tasks is not None else sure.limit(0), scratch)  # between labels of exact
    scratch.drop(sets, open_, sure)
    by_set = _labelled(rows.groupBy("s").agg(F.count("*").alias("n")), exact).drop("component").withColumnRenamed("label", "set_label")
    by_set = scratch.keep(_labelled(by_set, more, "set_label").select("s", "n", F.col("label").alias("component")))
    return join_spread(rows.select("id", "h", "s"), by_set, ["s"]).select("id", "h", "component")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group: that of the smallest id (null after all others), then of least text hash. Rows that share an id stay unless
    they are in one group."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("m")
    chosen = similar_groups(docs, width, similarity).groupBy("component").agg(first).select(F.col("m.id").alias("own_id"), F.col("m.h").alias("own_h")).distinct()
    hidden, names, text = hide(docs)
    kept = hidden.withColumn("id", doc_id(f"c{[n.lower() for n in names].index('doc_id')}")).withColumn("h", F.xxhash64(text))
    kept = kept.join(chosen, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("h") == F.col("own_h")), "left_semi")
    order = Window.partitionBy("id", "h").orderBy(text)
    return show(kept.withColumn("place", F.row_number().over(order)).where("place = 1"), names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(corpus(spark, sf_dir))
