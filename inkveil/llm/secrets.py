"""Secret scans over an incremental blob ledger, in DataFrame and SQL functions only.

Every version of a text is content-addressed by its SHA-256. The ledger has a row for each time a blob was scanned: the rule versions it
was then put through, and the spans they found. A scan looks up which pairs of blob and rule version the ledger lacks, runs those
rules alone on those blobs alone (each distinct blob once), and appends. Findings are joined back to all paths (rows) that hold a
blob; spans of rule versions that are no longer current are left out, so they stay in the ledger without showing.

A blob is read by a rule only if one of the rule's triggers is in it. Groups of equal blobs are merged before the shuffle, and a blob that
very many paths share meets them in many tasks.

Spans count code points and exclude their end. Base rules are assign, access and hex; the others add spans.

Cases: null text is empty text (no secrets); rows that repeat a doc_id stay rows; a null doc_id stays null; overlapping spans
of different rules are all reported; equal starts go by the order of the rules, then the end; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions.arrays import let, running
from inkveil.llm.common import Scratch, corpus, doc_id, join_spread


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    trigger: str  # a text in which this is not found has no match
    group: int = 0  # whose length counts
    least: int = 0

    @property
    def mark(self) -> str:
        return f"{self.kind}@{self.version}"


_WORDS = "password|passwd|secret|token|api_?key"
#: (?i) folds ASCII only here, and blanks are spelled out, so the patterns mean the same in any engine.
RULES = (
    Rule("assign", 1, rf"""(?i:{_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", f"(?i:{_WORDS})", 1, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", "AKIA", 0, 20),
    Rule("hex", 1, r"[0-9a-f]+", r"[0-9a-f]{24}", 0, 24),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\x09-\x0D\x20]{16,}?-----END [A-Z ]{0,20}PRIVATE KEY-----", "PRIVATE KEY"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ"),
    Rule("forge", 1, r"(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,})", "gh[pousr]_|github_pat_|glpat-"),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", "xox[abprs]-"),
    Rule("urlpass", 1, r"[a-z][a-z0-9+.-]{1,20}://[^\x09-\x0D\x20/:@\"']{1,64}:[^\x09-\x0D\x20/:@\"']{3,64}@[A-Za-z0-9.-]+", "://"),
)
SPAN = "struct<start:int,at:int,end:int,kind:string,version:int>"
LEDGER = f"blob string, scanned array<string>, spans array<{SPAN}>"
BASE = ("assign", "access", "hex")


def _spans(text: Column, rule: Rule, at: int) -> Column:
    """array<SPAN> of a rule, leftmost and not overlapping; offsets are running sums over the text between matches and the matches."""
    rx = F.lit(rule.pattern)
    none = F.array().cast(f"array<{SPAN}>")
    size = lambda x: F.length(x)

    def placed(found: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, rx, F.lit(-1)), F.lit(1), F.size(found)), found, lambda gap, m: F.length(gap) + F.length(m))
        counted = F.transform(F.regexp_extract_all(text, rx, F.lit(rule.group)), size) if rule.group else F.transform(found, size)

        def struct(m: Column) -> Column:
            return F.struct((m["end"] - m["size"]).cast("int").alias("start"), F.lit(at).alias("at"), m["end"].cast("int").alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"))

        rows = F.arrays_zip(running(steps).alias("end"), F.transform(found, size).alias("size"), counted.alias("counted"))
        return F.when(F.size(found) > 0, F.transform(F.filter(rows, lambda m: m["counted"] >= rule.least), struct)).otherwise(none)

    return F.when(text.rlike(rule.trigger), let(F.regexp_extract_all(text, rx, F.lit(0)), placed)).otherwise(none)


def address(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with text (null: empty) and blob, its content address."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.withColumn("text", whole).withColumn("blob", F.sha2(whole.cast("binary"), 256))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, addresses: DataFrame | None = None) -> DataFrame:
    """The ledger's new rows, for versions (blob, text): blob, the rule versions it had not been through, and what they found.

    addresses: the versions' blobs, if at hand in a kept table."""
    current = F.array(*(F.lit(r.mark) for r in rules)) if rules else F.array().cast("array<string>")
    todo = (versions if addresses is None else addresses).select("blob").distinct().withColumn("scanned", current)
    if ledger is not None:
        done = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("done"))  # rule versions of one blob
        left = F.array_except("scanned", F.coalesce("done", F.array().cast("array<string>")))
        todo = todo.join(done, "blob", "left").select("blob", left.alias("scanned")).where(F.size("scanned") > 0)
    some = versions.where(F.col("text").rlike("|".join(r.trigger for r in rules) or "(?!)"))
    texts = some.groupBy("blob").agg(F.first("text").alias("text"))
    both = todo.join(texts, "blob", "left")
    none = F.array().cast(f"array<{SPAN}>")
    found = [F.when(F.array_contains("scanned", r.mark) & F.col("text").isNotNull(), _spans(F.col("text"), r, i)).otherwise(none) for i, r in enumerate(rules)]
    return both.select("blob", "scanned", (F.concat(*found) if found else none).alias("spans"))


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans): what the current rule versions found in each blob that they found anything in, by start, then rule, then end."""
    kept = F.filter("spans", lambda s: F.concat_ws("@", s["kind"], s["version"].cast("string")).isin([r.mark for r in rules]))
    rows = ledger.select("blob", "scanned", kept.alias("spans")).where(F.size("spans") > 0).dropDuplicates(["blob", "scanned"])  # of scans at the same time
    return rows.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))  # a row for each scan of the blob


class Ledger:
    """The ledger as a Parquet folder that all executors reach. update() appends what is missing, and may be called again after a failure."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or Scratch(spark, "ledger").path

    def read(self) -> DataFrame | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(LEDGER).parquet(self.path) if there else None

    def update(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, addresses: DataFrame | None = None) -> None:
        scan(versions, self.read(), rules, addresses).write.mode("append").parquet(self.path)

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        return findings(self.read(), rules)


def secret_scan(docs: DataFrame, path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans. path: of the ledger, which is used and brought up to date; by default an
    empty one in the session's shared folder."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "secrets")
    versions = address(docs.select(doc_id().alias("doc_id"), "text"))
    paths = scratch.keep(versions.select("doc_id", "blob"))
    ledger = Ledger(spark, path)
    ledger.update(versions, rules, paths)
    found = scratch.keep(ledger.findings(rules).join(paths.groupBy("blob").agg(F.count("*").alias("n")), "blob"))
    all_ = join_spread(paths, found, ["blob"], "left").withColumn("s", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")))
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("s", lambda x: x["kind"].isin(*BASE))
    return all_.select("doc_id", *(n(k) for k in BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(corpus(spark, sf_dir))


def _sql(rules: tuple[Rule, ...]) -> str:
    def of(at: int, r: Rule) -> str:
        rx = r.pattern.replace("'", "''")
        whole = f"regexp_extract_all(text, '{rx}')"
        counted = f"regexp_extract_all(text, '{rx}', {r.group})"
        gaps = f"regexp_split_to_array(text, '{rx}')"
        rows = f"SELECT d, text, {whole} AS m, {counted} AS c, {gaps} AS g FROM docs"
        ends = f"SELECT d, unnest(range(1, len(m) + 1)) AS i, m, c, g FROM ({rows})"
        end = "list_sum(list_transform(g[:i], lambda x: length(x))) + list_sum(list_transform(m[:i], lambda x: length(x)))"
        return f"SELECT d, {at} AS rule, '{r.kind}' AS kind, {end} - length(m[i]) AS s, {end} AS e FROM ({ends}) WHERE length(c[i]) >= {r.least}"

    spans = " UNION ALL ".join(of(i, r) for i, r in enumerate(rules))
    base = ", ".join(f"'{k}'" for k in BASE)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({spans}),
named AS (SELECT *, kind || ':' || s::BIGINT || ':' || e::BIGINT AS name FROM spans),
per AS (
  SELECT d, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
         string_agg(name, ',' ORDER BY s, rule, e) FILTER (kind IN ({base})) AS base, string_agg(name, ',' ORDER BY s, rule, e) AS spans
  FROM named GROUP BY d)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (d)
"""


SQL = _sql(RULES)
