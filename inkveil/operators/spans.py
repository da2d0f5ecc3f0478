"""Span and segment algebra in Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions import arrays


def matches(text: str, pattern: str | Column) -> Column:
    """array<struct<start, end, text>> of a pattern's matches in a text column, in code points."""
    return arrays.matches(F.col(text), pattern)


def islands(spans: DataFrame, key: str) -> DataFrame:
    """(key, start, end, n): spans that overlap or touch, merged."""
    by = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    grouped = marked.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island")


def greedy(spans: Column) -> Column:
    """Of array<struct<rank, start, end, ...>>, the disjoint ones kept by falling rank, in order of start."""
    by_rank = F.array_sort(spans, lambda a, b: F.when(a["rank"] > b["rank"], -1).when(a["rank"] < b["rank"], 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    none = F.filter(spans, lambda _: F.lit(False))
    kept = F.aggregate(by_rank, none, lambda acc, s: F.when(F.exists(acc, lambda k: (s["start"] < k["end"]) & (k["start"] < s["end"])), acc).otherwise(F.concat(acc, F.array(s))))
    return F.array_sort(kept, lambda a, b: (a["start"] - b["start"]).cast("int"))


def segment_starts(segments: DataFrame, doc: str, order: str, text: str = "text", gap: int = 2) -> DataFrame:
    """Every segment's start in its document, segments being joined by `gap` characters."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("start", F.coalesce(F.sum(F.length(F.coalesce(text, F.lit(""))) + gap).over(w), F.lit(0)).cast("long"))


def bucket(entities: DataFrame, starts: DataFrame, doc: str, text: str = "text", straddle: str = "drop") -> DataFrame:
    """Document spans as spans of the segment that they begin in; those that leave it are dropped or clipped, as are those that begin
    between segments.

    An as-of join in one sort: segments and spans stand in one sequence by position, and a span takes the last segment before it."""
    more = [c for c in starts.columns if c not in (doc, "start", text)]
    segment = F.struct(F.col("start").cast("long").alias("from"), (F.col("start") + F.length(text)).cast("long").alias("to"), *more)
    segments = starts.select(doc, F.col("start").cast("long").alias("at"), F.lit(0).alias("is_span"), segment.alias("segment"))
    spans_ = entities.select(doc, F.col("start").cast("long").alias("at"), F.lit(1).alias("is_span"), F.struct(*(c for c in entities.columns if c != doc)).alias("span"))
    both = segments.unionByName(spans_, allowMissingColumns=True)
    before = Window.partitionBy(doc).orderBy("at", "is_span").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("segment", F.last("segment", ignorenulls=True).over(before)).where("is_span = 1 and at < segment.to")
    if straddle == "drop":
        placed = placed.where("span.end <= segment.to")
    kind = entities.schema["start"].dataType
    rows = placed.select(doc, "span.*", F.col("segment.from").alias("seg_from"), F.col("segment.to").alias("seg_to"), *(F.col(f"segment.{c}").alias(c) for c in more))
    moved = {"start": F.col("start") - F.col("seg_from"), "end": F.least("end", "seg_to") - F.col("seg_from")}
    return rows.withColumns({c: x.cast(kind) for c, x in moved.items()}).drop("seg_from", "seg_to")
