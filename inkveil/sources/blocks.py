"""Repair of extracted text blocks, as Catalyst expressions: characters of converters go, wrapped addresses and split blocks are joined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks that become a space, invisible characters that go, and the domain endings that a stray blank may precede.
BLANKS = "\u00a0\u2007\u202f"
INVISIBLE = "\u200b\u200c\u200d\ufeff\u00ad"
ENDINGS = "com|in|net|org|io|gov|edu|biz|info"


def clean(text: Column) -> Column:
    """A block with invisible characters, wrapped mailboxes and hosts, split endings and surplus blanks mended; null stays null."""
    out = F.translate(text, BLANKS + INVISIBLE, " " * len(BLANKS))
    for pattern, new in (
        (r"(?U)(@[\w.-]*|(?:https?://|www\.)[\w./-]*)\n[^\S\n]*(?=\w)", "$1"),
        (rf"(?U)(?<=[\w-])\.\s+({ENDINGS})\b", ".$1"),
        (r"(?U)[^\S\n]{2,}", " "),
        (r"\n{3,}", "\n\n"),
        (r"(?U)\A\s+|\s+\z", ""),
    ):
        out = F.regexp_replace(out, pattern, new)
    return out


def _glue(before: Column, after: Column) -> Column:
    """What joins a block to the one before it; null where it begins anew."""
    tight = F.when(before.rlike(r"(?U)[@.]\S*\s*\z"), "").otherwise(" ")
    return (
        F.when(~before.rlike(r"(?U)\S") | ~after.rlike(r"(?U)\S") | before.rlike(r"(?U)[.!?:;]\s*\z"), F.lit(None).cast("string"))
        .when(before.rlike(r"(?U)[-–—]\s*\z"), " ")
        .when(before.rlike(r"(?U)\d\s*\z") & after.rlike(r"(?U)\A\s*\d"), " ")
        .when(after.rlike(r"(?U)\A\s*[\p{Ll}.,)@]"), tight)
    )


def merge(blocks: Column) -> Column:
    """array<string> of blocks, with those that go on in the next one joined to it, cleaned. Nulls count as no block."""

    def step(acc: Column, block: Column) -> Column:
        glue = _glue(acc["last"], block)
        return F.when(acc["last"].isNull(), F.struct(acc["done"].alias("done"), block.alias("last"))).otherwise(
            F.when(glue.isNull(), F.struct(F.array_append(acc["done"], acc["last"]).alias("done"), block.alias("last"))).otherwise(
                F.struct(acc["done"].alias("done"), F.concat(acc["last"], glue, block).alias("last"))
            )
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("last"))
    whole = F.aggregate(F.filter(blocks, lambda b: b.isNotNull()), start, step, lambda a: F.when(a["last"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["last"])))
    return F.transform(whole, clean)


def paragraphs(text: Column, tidy: bool = True) -> Column:
    """Segments of a plain text at blank lines; tidy strips them and leaves out empty ones (offsets then differ)."""
    parts = F.split(text, "\n\n", -1)
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)\A\s+|\s+\z", "")), lambda p: p != "") if tidy else parts
