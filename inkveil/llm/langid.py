"""Language identification of pages by Bayesian evidence fusion.

Four kinds of evidence: the text's likelihood under hashed byte-trigram models, the language that the markup declares, the
address suffix, and the host. A first posterior of each page joins text and declaration. Its sums by host are rolled up to the
registered domain, the suffix and all pages, and each level's prior is smoothed by the level above it (Dirichlet weight
`strength`); a page's own share is taken out of its host's sum first, so no page is evidence for itself. The final posterior
joins text, declaration and prior.

The models are fitted on all documents of a language of up to 4 * `per_language`, else on about 2 * `per_language` (those below a
cut-off of a hash, the same in every task; equal texts count once), a documented bound; their trigrams are counted in the tasks. All pages are
scored, whole, and all pages count in the priors. Sums over hosts are pre-aggregated before the shuffle, and a host of very many pages
meets them in many tasks.

Cases: null or empty html has no text evidence; a missing or unknown declaration is no evidence; a null or odd url has the
empty host, which is a host like another; ties go to the first language in order; null page_ids and repeated rows stay; without
training documents every language column is null; more than 1000 languages are an error; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import Scratch, corpus, join_spread

BUCKETS = 1 << 14
MULT = np.uint64(0x9E3779B97F4A7C15)
MOST_LANGUAGES = 1000
#: Second-level labels under which countries register names.
SECOND = "ac|co|com|edu|go|gob|gov|gouv|mil|ne|net|nom|or|org"


def _codes(text: bytes | None) -> np.ndarray:
    raw = np.frombuffer(b" " + (text or b"").lower() + b" ", np.uint8).astype(np.uint64)
    if len(raw) < 5:
        return np.zeros(0, np.int64)
    key = raw[:-2] << np.uint64(16) | raw[1:-1] << np.uint64(8) | raw[2:]
    return ((key * MULT) >> np.uint64(50)).astype(np.int64)


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """(lang, text): the texts to fit on."""
    rows = docs.where("lang is not null").select(F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    cut = {lang: int(2**64 * (2 * per_language / n)) - 2**63 for lang, n in sizes.items() if n > 4 * per_language}
    below = F.lit(True)
    for lang, most in cut.items():
        below = F.when(F.col("lang") == lang, F.col("h") < most).otherwise(below)
    return rows.withColumn("h", F.xxhash64("text")).where(below).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def fit(docs: DataFrame, per_language: int = 400) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log-likelihoods (language, bucket)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[lang] = sums.get(lang, 0) + np.bincount(_codes(text), minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    langs = sorted(r.lang for r in docs.where("lang is not null").select(F.col("lang").cast("string").alias("lang")).distinct().collect())
    chosen = sample(docs, per_language).select("lang", F.col("text").cast("binary").alias("text"))
    got = chosen.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages * BUCKETS rows at most
    counts = np.ones((len(langs), BUCKETS))
    place = {lang: i for i, lang in enumerate(langs)}
    np.add.at(counts, ([place[x] for x in got["lang"].to_pylist()], got["bucket"].to_numpy()), got["n"].to_numpy())
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def visible(html: Column) -> Column:
    """The text of a page without scripts, styles, comments, navigation, tags and entities."""
    out = F.regexp_replace(html, r"(?is)<(script|style|nav|footer)\b.*?</\1>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(out, r"<[^>]*>", " "), r"&[A-Za-z0-9#]{1,10};", " ")


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def domain_of(host: Column) -> Column:
    """The registered domain: the last two labels, or three under a country's second-level label (bbc.co.uk); the host if it has one."""
    return F.regexp_extract(host, rf"[^.]+\.(?:{SECOND})\.[a-z]{{2}}$|[^.]+\.[^.]+$|^[^.]*$", 0)


def evidence(pages: DataFrame, model: tuple[list[str], np.ndarray], weight: int = 200) -> DataFrame:
    """page_id, host, domain, suffix, declared, ll: the text's log-likelihoods, each page counting for at most `weight` trigrams."""
    known = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logp = known.value
        for b in batches:
            out = []
            for t in b.column(b.num_columns - 1).to_pylist():
                c = _codes(t)
                out.append((logp[:, c].mean(axis=1) * min(len(c), weight)).astype(float) if len(c) else np.zeros(len(langs)))
            yield pa.record_batch([*b.columns[:-1], pa.array(out, pa.list_(pa.float64()))], [*b.schema.names[:-1], "ll"])

    host = host_of(F.col("url"))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        host.alias("host"),
        domain_of(host).alias("domain"),
        F.regexp_extract(host, r"([^.]*)$", 1).alias("suffix"),
        F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]{2})", 1)).alias("declared"),
        visible(F.coalesce(F.col("html").cast("string"), F.lit(""))).cast("binary").alias("text"),
    )
    return rows.mapInArrow(run, "page_id long, host string, domain string, suffix string, declared string, ll array<double>")


def _softmax(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    exps = [F.exp(x - top) for x in logs]
    total = sum(exps[1:], exps[0])
    return [e / total for e in exps]


def identify(pages: DataFrame, docs: DataFrame, trust: float = 0.9, strength: float = 5.0, per_language: int = 400) -> DataFrame:
    """page_id, host, declared, text_lang (by text alone), lang, confidence."""
    model = fit(docs, per_language)
    langs = model[0]
    scratch = Scratch(pages.sparkSession, "langid")
    rows = scratch.keep(evidence(pages, model))
    if not langs:
        none = F.lit(None)
        return rows.select("page_id", "host", "declared", none.cast("string").alias("text_lang"), none.cast("string").alias("lang"), none.cast("double").alias("confidence"))
    n = len(langs)
    ll = [F.get("ll", F.lit(i)) for i in range(n)]
    rest = (1 - trust) / max(1, n - 1)
    said = [F.when(F.col("declared") == lang, math.log(trust)).when(F.col("declared").isin(*langs), math.log(rest)).otherwise(0.0) for lang in langs]
    rows = rows.select("page_id", "host", "domain", "suffix", "declared", "ll", *(p.alias(f"p{i}") for i, p in enumerate(_softmax([a + b for a, b in zip(ll, said)]))))
    sums = lambda d, *by: d.groupBy(*by).agg(F.sum("n").alias("n"), *(F.sum(f"p{i}").alias(f"p{i}") for i in range(n)))
    hosts = scratch.keep(sums(rows.withColumn("n", F.lit(1)), "host", "domain", "suffix"))
    domains, suffixes = scratch.keep(sums(hosts, "domain", "suffix")), scratch.keep(sums(hosts, "suffix"))
    every = suffixes.agg(*(F.coalesce(F.sum(f"p{i}"), F.lit(0.0)).alias(f"p{i}") for i in range(n))).first()
    base = [(every[i] + strength / n) / (sum(every) + strength) for i in range(n)]

    def smooth(own: list[Column], above: list) -> list[Column]:
        total = sum(own[1:], own[0])
        return [(o + strength * a) / (total + strength) for o, a in zip(own, above)]

    p = [F.col(f"p{i}") for i in range(n)]
    q = [F.col(f"q{i}") for i in range(n)]
    named = lambda cols: [x.alias(f"q{i}") for i, x in enumerate(cols)]
    counted = lambda d, low, *by: low.groupBy(*by).agg(F.count("*").alias("n")).join(d, [*by])  # noqa: E731  how many rows of the level below meet one of d
    top = scratch.keep(counted(suffixes.select("suffix", *named(smooth(p, [F.lit(b) for b in base]))), domains, "suffix"))
    middle = join_spread(domains.drop("n"), top, ["suffix"]).select("domain", "suffix", *named(smooth(p, q)))
    middle = scratch.keep(counted(middle, hosts, "domain", "suffix"))
    prior = scratch.keep(join_spread(hosts.select("host", "domain", "suffix", F.col("n").alias("pages"), *p), middle, ["domain", "suffix"]).select("host", F.col("pages").alias("n"), *(x.alias(f"h{i}") for i, x in enumerate(p)), *q))
    final = join_spread(rows, prior, ["host"])
    own = [F.greatest(F.col(f"h{i}") - F.col(f"p{i}"), F.lit(0.0)) for i in range(n)]
    post = _softmax([a + b + F.log(c) for a, b, c in zip(ll, said, smooth(own, q))])
    best = F.array_max(F.array(*(F.struct(x.alias("p"), F.lit(-i).alias("i")) for i, x in enumerate(post))))
    name = lambda i: F.get(F.array(*map(F.lit, langs)), i)
    text_best = F.array_max(F.array(*(F.struct(x.alias("p"), F.lit(-i).alias("i")) for i, x in enumerate(ll))))
    return final.select("page_id", "host", "declared", F.when(F.array_max("ll") != 0, name(-text_best["i"])).alias("text_lang"), best.alias("best")).select("page_id", "host", "declared", "text_lang", name(-F.col("best.i")).alias("lang"), F.col("best.p").alias("confidence"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(corpus(spark, sf_dir, "pages"), corpus(spark, sf_dir))
