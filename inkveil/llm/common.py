"""Shared plumbing of the corpus operators: tables, durable scratch tables, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(range(256)).lower()
#: Lower-cases, and turns every ASCII byte outside 0-9 and a-z into a blank; bytes of other characters stay.
ALNUM = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose rows are dealt out for costly work per row."""
    return spread(table(spark, sf_dir, name))


def hide(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[str], str]:
    """docs with its columns renamed c0, c1, ... by position, its own names, and the new name of the text column.

    Operators work on hidden columns, so columns of any name, repeated ones too, cannot clash with theirs."""
    names = docs.columns
    at = [n.lower() for n in names].index(text.lower())
    return docs.toDF(*(f"c{i}" for i in range(len(names)))), names, f"c{at}"


def show(hidden: DataFrame, names: list[str], *more: str, **instead: str | Column) -> DataFrame:
    """The hidden columns under their own names, then `more`; a column that has the name of a new one gives way to it. instead: new
    values for hidden columns."""
    taken = {m.lower() for m in more}
    own = [F.col(f"c{i}") if f"c{i}" not in instead else instead[f"c{i}"] for i in range(len(names))]
    own = [(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(own, names) if n.lower() not in taken]
    return hidden.select(*own, *more)


def doc_id(col: str = "doc_id") -> Column:
    return F.col(col).cast("long")


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may lack it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
    return root.rstrip("/")


class Scratch:
    """Tables written once to the shared folder, so that a lost executor costs no more than its own tasks."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.path = spark, f"{scratch_root(spark)}/inkveil-{tag}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame, **seen: Column) -> DataFrame:
        """df, written and read again. Its number of rows, the sum of a column n and the aggregates `seen` are taken while it is written,
        and stand in the attribute seen."""
        self.n += 1
        at = f"{self.path}/{self.n:03d}"
        if "n" in df.columns:
            seen["sum_n"] = F.sum("n")
        watch = Observation()
        df.observe(watch, F.count(F.lit(1)).alias("rows"), *(c.alias(name) for name, c in seen.items())).write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out.seen, out._scratch_path = watch.get, at
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that keep() wrote and nothing will read again."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, factor: int = 4) -> DataFrame:
    """df, or its rows dealt out anew if the largest split has more than twice a core's even share, as a file of one row group has.

    The test counts rows by split, which reads no column."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    by_split = df.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    largest, total = by_split.agg(F.max("n"), F.sum("n")).first()
    return df.repartition(factor * cores) if largest and largest * cores > 2 * total and total > factor * cores else df


SHARE = 4096


def join_spread(rows: DataFrame, by_key: DataFrame, keys: list[str], how: str = "inner", seen: dict | None = None) -> DataFrame:
    """rows joined with by_key, a kept table of one row per key and the number `n` of rows that have it (n is dropped).

    Keys of more than 1/4096 of all rows, so 4096 of them at most, are broadcast with their number of parts: their rows are dealt
    over as many tasks, and their row of by_key is repeated for each."""
    least = max(100, int((seen or by_key.seen)["sum_n"] or 0) // SHARE)
    heavy = F.broadcast(by_key.where(F.col("n") > least).select(*keys, F.ceil(F.col("n") / least).cast("int").alias("_parts")))
    other = [c for c in rows.columns if c not in keys]  # a row's part follows from its values, so a task that runs again deals alike
    part = F.pmod(F.xxhash64(*other), F.col("_parts")).cast("int") if other else F.lit(0)
    dealt = rows.join(heavy, keys, "left").withColumn("_part", F.coalesce(part, F.lit(0))).drop("_parts")
    again = by_key.drop("n").join(heavy, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(again, [*keys, "_part"], how).drop("_part")


def least_hashes(df: DataFrame, key: str, most: int) -> DataFrame:
    """Rows of df that hold all of the `most` least hashes of key, and about `most` more: a cut-off that is the same in every task."""
    n = df.count()
    if n <= 2 * most:
        return df
    return df.where(F.xxhash64(key) < F.lit(int(-(2**63) + 2**64 * 2 * most / n)))


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in edges (a, b) that is not the smallest reachable id itself, component being that.

    Alternates large-star and small-star contraction. A round groups by node with a map-side minimum and joins
    that minimum back, so a node with very many neighbours is split by the skew join and never gathered.
    """
    mark = {"x": F.bit_xor(F.xxhash64("a", "b")), "s": F.sum(F.col("b").cast("decimal(38,0)"))}
    state = scratch.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), **mark)
    for _ in range(max_rounds if state.seen["rows"] else 0):
        both = state.union(state.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("b", "a", "m")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = scratch.keep(small, **mark)
        scratch.drop(state)
        done, state = new.seen == state.seen, new
        if done:
            break
    else:
        if state.seen["rows"]:
            raise RuntimeError("components did not settle")
    out = state.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    out.seen = state.seen
    return out
