"""Document fingerprints of closed syncmers, in DataFrame and SQL functions only.

A text is cut into tokens: runs of non-blanks of up to 16 characters, single characters of scripts that are written without blanks,
and of longer runs pieces that end behind one of the characters CUT (or after 64), up to the last 16 characters. So what a token is depends on the characters
around it, not on how far the text's or run's start is. Of every run of 4 tokens (a k-mer), the 3 inner runs of 2 tokens (s-mers)
are hashed; the k-mer is an anchor if its least s-mer lies at an edge, that is unless the middle one is strictly the least. That
depends on the k-mer alone, so equal passages have equal anchors wherever they stand.

The fingerprint lists the anchors' 32-bit hashes with their distance (in tokens) from the anchor before, whole texts, in order:
`hash+gap`. Likeness matches positions: a step is an anchor, its gap and the anchor before it (the first anchor is a step by itself),
and likeness is the share of common steps among all steps of both texts (0 to 1).

Cases: null text is empty text, whose fingerprint is the single anchor of no tokens (so two empty texts are alike); a text
without a closed syncmer (fewer than 4 tokens, or few more) is one anchor, of all its tokens; texts of blanks count as empty; equal texts
have equal fingerprints; a null doc_id comes last in descending order; rows that repeat a doc_id follow each other by a hash of their
text, then the text; one row alone is its own next; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.functions.arrays import let
from inkveil.llm.common import Scratch, corpus, doc_id, least_hashes

K, S = 4, 2
#: Characters of scripts written without blanks between words: Thai and Lao, Burmese, Khmer, kana, Chinese characters.
UNSPACED = r"฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\x{20000}-\x{3FFFF}"
#: All others but ASCII blanks, as ranges, which are quicker to test than a complement.
RUN = r"[\x21-෿\x00-\x08\x0E-\x1Fༀ-࿿Ⴀ-᝿᠀-〿㄀-㏿䷀-䷿ꀀ-ﬀ-￿\x{10000}-\x{1FFFF}\x{40000}-\x{10FFFF}]"
CUT = "aeimquyAEIMQUY048/=,;.(){}<>"
TOKEN = rf"{RUN}{{1,16}}+(?!{RUN})|[{UNSPACED}]|{RUN}{{0,63}}?[{CUT}]|{RUN}{{1,64}}"
DOCS_PER_BUCKET = 256
MOST_BUCKETS = 1 << 15


def _anchor(h: Column) -> Column:
    return F.shiftright(h, 32).cast("int")


def anchors(text: Column) -> Column:
    """array<struct<h int, at int>>: the closed syncmers in order, at counting tokens."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))

    def of_hashes(h: Column) -> Column:
        smers = F.transform(F.slice(h, 1, F.size(h) - (S - 1)), lambda x, i: F.xxhash64(x, F.get(h, i + 1)))

        def of_smers(s: Column) -> Column:
            def pick(x: Column, i: Column) -> Column:
                mid, end = F.get(s, i + 1), F.get(s, i + 2)
                return F.when((mid >= x) | (mid >= end), F.struct(_anchor(F.xxhash64(x, end)).alias("h"), i.alias("at")))

            return F.array_compact(F.transform(F.slice(s, 1, F.size(s) - (K - S)), pick))

        return let(smers, of_smers)

    def of_tokens(w: Column) -> Column:
        short = F.array(F.struct(_anchor(F.xxhash64(F.array_join(w, " "))).alias("h"), F.lit(0).alias("at")))
        found = F.when(F.size(w) >= K, let(F.transform(w, lambda x: F.xxhash64(x)), of_hashes))
        return let(found, lambda a: F.when(F.size(a) > 0, a).otherwise(short))

    return let(tokens, of_tokens)


def fingerprint(a: Column) -> Column:
    """The anchors as text: hexadecimal hash and the distance from the anchor before."""
    return F.array_join(F.transform(a, lambda x, i: F.concat(F.lower(F.hex(x["h"].bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit("+"), (x["at"] - F.when(i > 0, F.get(a, i - 1)["at"]).otherwise(0)).cast("string"))), ".")


def steps(a: Column) -> Column:
    """array<int>: a hash of each anchor with its gap and the anchor before."""
    return F.transform(a, lambda x, i: F.when(i == 0, x["h"]).otherwise(_anchor(F.xxhash64(F.get(a, i - 1)["h"], x["at"] - F.get(a, i - 1)["at"], x["h"]))))


def likeness(a: Column, b: Column) -> Column:
    """Common steps over all steps."""
    return let(F.size(F.array_intersect(a, b)), lambda common: common / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - common))


def _bucket(rows: DataFrame, n: int) -> DataFrame:
    """rows with code: the number of a bucket of about DOCS_PER_BUCKET rows, or of n / MOST_BUCKETS if that is more, rising with the order
    of descending ids. Bounds are quantiles of the ids (of half a million of them at most, by hash); an id of very many rows has buckets of its own, by
    ranges of h."""
    per = max(DOCS_PER_BUCKET, -(-n // MOST_BUCKETS))
    ids = least_hashes(rows.select("id").where("id is not null"), "id", 1 << 19).distinct().toArrow()["id"].to_numpy()
    many = {r.id: -(-r.n // per) for r in rows.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > 2 * per).collect()}  # n / (2 * per) of them at most
    edges = np.array([i + d for i in many if i is not None for d in (0, 1) if i + d < 2**63], np.int64)
    cuts = np.unique(np.concatenate([np.sort(ids)[:: max(1, round(len(ids) * per / n))][1:], edges]))
    bounds = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>") if len(cuts) else F.array().cast("array<bigint>")

    def below(i: Column) -> Column:
        """How many bounds are at most i: bit by bit, from the highest."""
        powers = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))
        return F.aggregate(powers, F.lit(0), lambda pos, p: pos + F.when(F.get(bounds, pos + p - 1) <= i, p).otherwise(0))

    place = F.when(F.col("id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - below(F.col("id")) if len(cuts) else F.lit(0))
    sub = F.lit(0)
    if many:
        known = F.broadcast(rows.sparkSession.createDataFrame(list(many.items()), "hot long, parts long"))
        rows = rows.join(known, F.col("id").eqNullSafe(F.col("hot")), "left")
        sub = F.when(F.col("parts").isNull(), 0).otherwise(F.least(F.floor((F.col("h") / 2.0**64 + 0.5) * F.col("parts")), F.col("parts") - 1))
    return rows.withColumn("code", place.cast("bigint") * (1 << 21) + sub).drop("hot", "parts")


def _next_rows(rows: DataFrame) -> DataFrame:
    """rows (id, h, text) with anchors a and next, the text and steps of the row after it in descending id, the first after the last.

    The row that opens a bucket also goes to the bucket before it, so every row finds its successor inside its bucket; texts are
    dealt out once, and their anchors found after that."""
    spark = rows.sparkSession
    n = rows.count()
    if not n:
        return rows.select("*", anchors(F.col("text")).alias("a")).withColumn("next", F.struct("text", steps(F.col("a")).alias("steps")))
    rows = _bucket(rows, n).withColumn("r", F.bitwise_not("id"))  # ascends as the id descends
    heads = Scratch(spark, "next").keep(rows.groupBy("code").agg(F.min(F.struct("r", "h")).alias("m")))
    first = sorted((r.code, r.m.r, r.m.h) for r in heads.collect())  # 3 longs for each bucket, of which there are at most 4 * MOST_BUCKETS
    guests = [(code, r, h, first[i - 1][0]) for i, (code, r, h) in enumerate(first)]
    before = F.broadcast(spark.createDataFrame(guests, "hc long, hr long, hh long, also long"))
    dealt = rows.join(before, (F.col("code") == F.col("hc")) & F.col("r").eqNullSafe(F.col("hr")) & (F.col("h") == F.col("hh")), "left")
    places = F.array(F.struct("code", F.lit(False).alias("guest")), F.struct(F.col("also").alias("code"), F.lit(True).alias("guest")))
    dealt = dealt.select("id", "r", "h", "text", F.explode(F.filter(places, lambda x: x["code"].isNotNull())).alias("p"))
    dealt = dealt.select("id", "r", "h", "text", "p.code", "p.guest").repartition("code").withColumn("a", anchors(F.col("text"))).withColumn("s", steps(F.col("a")))
    within = Window.partitionBy("code").orderBy("guest", "r", "h", "text")
    return dealt.withColumn("next", F.lead(F.struct("text", F.col("s").alias("steps"))).over(within)).where("not guest").drop("r", "h", "code", "guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select(doc_id().alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    d = _next_rows(rows)
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("next.text"), F.lit(1), third))
    d = d.select("id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "a", steps(F.col("a")).alias("s"), F.col("next.steps").alias("b"))
    d = d.withColumn("e", anchors(F.col("edited")))
    return d.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("a")).alias("fingerprint"),
        fingerprint(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("s"), steps(F.col("e"))).alias("near_edited"),
        likeness(F.col("s"), F.col("b")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(corpus(spark, sf_dir))
