"""Array helpers as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 128
SPAN = "struct<start:int,end:int,text:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(sizes: Column) -> Column:
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(sizes, start, lambda acc, x: let(acc["sum"] + x, lambda s: F.struct(s.alias("sum"), F.array_append(acc["out"], s).alias("out"))))


def running(sizes: Column) -> Column:
    """array<bigint>: every element's sum with all before it. An append copies its array, so sums are made in chunks and shifted."""

    def chunked(a: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), ((F.size(a) - 1) / CHUNK).cast("int")), lambda k: _scan(F.slice(a, k * CHUNK + 1, F.lit(CHUNK))))

        def shifted(p: Column) -> Column:
            before = _scan(F.transform(p, lambda x: x["sum"]))["out"]
            return let(before, lambda b: F.flatten(F.transform(p, lambda x, i: F.transform(x["out"], lambda y: y + F.when(i > 0, F.get(b, i - 1)).otherwise(0)))))

        return let(parts, shifted)

    return let(sizes, lambda a: F.when(F.size(a) <= CHUNK, _scan(a)["out"]).otherwise(chunked(a)))


def matches(text: Column, pattern: str | Column) -> Column:
    """array<struct<start, end, text>> of a pattern's matches in code points, in order; null for null text.

    Offsets are running sums over what lies between and in the matches; a text without a match is read once only."""
    rx = F.lit(pattern) if isinstance(pattern, str) else pattern

    def placed(found: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, rx, F.lit(-1)), F.lit(1), F.size(found)), found, lambda gap, m: F.length(gap) + F.length(m))
        ends = lambda e: F.transform(found, lambda m, i: let(F.get(e, i).cast("int"), lambda end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("text"))))
        return F.when(F.size(found) > 0, let(running(steps), ends)).otherwise(F.array().cast(f"array<{SPAN}>"))

    return F.when(text.isNotNull(), let(F.regexp_extract_all(text, rx, F.lit(0)), placed))
