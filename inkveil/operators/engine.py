"""The document pipeline as DataFrame operators: detect, redact, report.

Rows are documents: an id, a text, and whatever else. What patterns find is a Catalyst expression over the text. Only texts with such a
finding, or with the cue of a name, company or address, go on to Python, in Arrow batches, for the detectors that go by structure, for
the second pass, resolution and surrogates; the others, mostly nearly all, and all other columns stay in the JVM. Entities
stay an array in the row, so nothing shuffles until a report groups them. Null text has no entities and stays null.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.operators import names, patterns, policy
from inkveil.operators.patterns import ENTITY, Span
from inkveil.operators.spread import spread
from inkveil.operators.surrogates import Surrogates
from inkveil.settings import PRIORITY, TYPES, Settings

MAPPING = "array<struct<type:string,original:string,surrogate:string>>"
RESULT = f"struct<entities:array<{ENTITY}>,redacted:string,mapping:{MAPPING}>"
Detector = Callable[[str], Iterator[Span]]
log = logging.getLogger(__name__)


def rank(s: Span) -> tuple:
    return PRIORITY[s[0]], s[2] - s[1], s[4], -s[1]


def resolve(spans: list[Span], min_score: float = 0.0) -> list[Span]:
    """Disjoint spans in order: the best of each (start, end), then greedily by rank."""
    best: dict[tuple[int, int], Span] = {}
    for s in spans:
        if s[4] >= min_score and (s[1:3] not in best or rank(s) > rank(best[s[1:3]])):
            best[s[1:3]] = s
    kept: list[Span] = []
    for s in sorted(best.values(), key=rank, reverse=True):
        if all(s[2] <= k[1] or k[2] <= s[1] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s[1])


def analyze(text: str, settings: Settings, more: list[Detector] = (), found: list[Span] | None = None) -> list[Span]:
    """All entities of a text. found: what patterns find in it, if known. A detector of `more` that fails is logged and left out."""
    types, exempt = frozenset(settings.types), policy.exempter(settings)
    found = list(patterns.find(text, settings) if found is None else found)
    if "ADDRESS" in types:
        found += names.addresses(text)
    if "ORGANIZATION" in types:
        found += names.organizations(text, exempt)
    if "PERSON" in types:
        found += names.people(text)
    for detector in more:
        try:
            found += [s for s in detector(text) if s[0] in types]
        except Exception:  # a user's rule must not stop the job
            log.exception("detector %r failed", detector)
    found += policy.denied(text, settings)
    if settings.propagate:
        found += spread(text, resolve(found, settings.min_score), types, exempt)
    return resolve(found, settings.min_score)


def _wanted(text: Column, settings: Settings, more: list[Detector]) -> Column:
    """Could anything but patterns find something in the text?"""
    if more:
        return text != ""
    denied = [re.escape(v) for values in settings.deny.values() for v in values]
    cue = [names.CUE] * bool({"PERSON", "ORGANIZATION", "ADDRESS"} & set(settings.types)) + denied
    return text.rlike("|".join(cue)) if cue else F.lit(False)


def rewrite(text: str, spans: list[Span], seed: str) -> tuple[str, dict[tuple[str, str], str]]:
    s = Surrogates(seed, [text[a:b] for k, a, b, *_ in spans if k == "PERSON"])
    out, at = [], 0
    for kind, start, end, *_ in spans:
        if start >= at:
            out += [text[at:start], s.of(kind, text[start:end])]
            at = end
    return "".join([*out, text[at:]]), s.made


def detect(df: DataFrame, settings: Settings = Settings(), text: str = "text", more: list[Detector] = (), redact: bool = True) -> DataFrame:
    """df with entities, redacted and mapping."""

    @F.arrow_udf(RESULT)
    def work(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, candidates in parts:
            rows = []
            for t, found in zip(texts, candidates):
                t = t.as_py()
                if not t:
                    rows.append({"entities": [], "redacted": t, "mapping": []})
                    continue
                spans = analyze(t, settings, more, [(e["type"], e["start"], e["end"], e["recognizer"], e["score"], e["notes"]) for e in found.as_py()])
                new, made = rewrite(t, spans, settings.seed) if spans and redact else (t, {})
                rows.append(
                    {
                        "entities": [dict(zip(("type", "start", "end", "text", "recognizer", "score", "notes"), (k, s, e, t[s:e], n, round(v, 3), note))) for k, s, e, n, v, note in spans],
                        "redacted": new,
                        "mapping": [{"type": k, "original": o, "surrogate": v} for (k, o), v in sorted(made.items())] if settings.emit_mapping else [],
                    }
                )
            yield pa.array(rows, kind)

    entity = pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("recognizer", pa.string()), ("score", pa.float64()), ("notes", pa.string())])
    pair = pa.struct([("type", pa.string()), ("original", pa.string()), ("surrogate", pa.string())])
    kind = pa.struct([("entities", pa.list_(entity)), ("redacted", pa.string()), ("mapping", pa.list_(pair))])
    own = F.col(text).cast("string")
    given = df.withColumn("__found", patterns.candidates(own, settings))
    given = given.withColumn("__text", F.when((F.size("__found") > 0) | _wanted(own, settings, more), own))
    # Not to be moved or repeated by the optimizer, which cannot evaluate it inside a generator.
    done = given.withColumn("__done", work.asNondeterministic()("__text", "__found"))
    out = F.when(F.col("__text").isNotNull(), F.col("__done.redacted")).otherwise(own)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("entities", "redacted", "mapping")]
    return done.select(*kept, F.col("__done.entities").alias("entities"), out.alias("redacted"), F.col("__done.mapping").alias("mapping"))


def entities(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row per entity."""
    return found.select(key, F.explode("entities").alias("e")).select(key, "e.*")


def counts(found: DataFrame) -> DataFrame:
    """type, n: in the types' own order, zeros left out."""
    order = F.array_position(F.array(*map(F.lit, TYPES)), F.col("type"))
    return found.select(F.explode("entities.type").alias("type")).groupBy("type").agg(F.count("*").alias("n")).orderBy(order)


def by_recognizer(found: DataFrame) -> DataFrame:
    """type, recognizer, n, distinct values, and share of all entities."""
    rows = found.select(F.explode("entities").alias("e")).groupBy("e.type", "e.recognizer", "e.text").agg(F.count("*").alias("n"))
    counted = rows.groupBy("type", "recognizer").agg(F.sum("n").alias("n"), F.count("*").alias("distinct_values"))
    total = F.broadcast(counted.agg(F.sum("n").alias("total")))
    return counted.crossJoin(total).select("type", "recognizer", "n", "distinct_values", F.round(F.col("n") / F.col("total"), 4).alias("share"))


def mapping(found: DataFrame) -> DataFrame:
    return found.select(F.explode("mapping").alias("m")).select("m.*").distinct()


def summary(found: DataFrame, settings: Settings) -> DataFrame:
    """One row for the report; the seed appears as a fingerprint, for it can undo pseudonyms."""
    import hashlib

    mark = hashlib.sha256(settings.seed.encode()).hexdigest()[:12]
    types = found.select(F.explode_outer("entities.type").alias("type"))
    return types.groupBy("type").count().agg(F.sum(F.when(F.col("type").isNotNull(), F.col("count")).otherwise(0)).alias("entities"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("type").isNotNull(), F.struct("type", "count"))))).alias("by_type")).withColumn("seed_fingerprint", F.lit(mark))
