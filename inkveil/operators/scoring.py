"""Scores of detected entities against gold labels, as joins and folds over small arrays.

Both sides are (id, entities), entities being an array of structs with type, start and end. Numbers whose denominator is 0 are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.operators import spans


def read_labels(spark, path: str) -> DataFrame:
    """(id, index, anchor, stratum, text, labels) of a JSON file with an array `records` whose entities have type, text and, if not the
    first, occurrence. Records have their text, or the index of a paragraph and the anchor that it starts with."""
    label = "array<struct<type:string,text:string,occurrence:int>>"
    schema = f"records array<struct<id:string,index:int,anchor:string,stratum:string,text:string,entities:{label}>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("records").alias("r"))
    return rows.select(F.coalesce("r.id", F.col("r.index").cast("string")).alias("id"), "r.index", "r.anchor", "r.stratum", "r.text", F.col("r.entities").alias("labels"))


def with_paragraphs(records: DataFrame, segments: DataFrame) -> DataFrame:
    """records with the text of their paragraph, of segments (index, text). An index without a paragraph, or a paragraph that does not
    start with the record's anchor, is an error."""
    joined = records.drop("text").join(segments.select("index", "text"), "index", "left")
    where = F.concat(F.lit("record "), F.col("id"), F.lit(", paragraph "), F.col("index").cast("string"))
    bad = F.when(F.col("text").isNull(), F.raise_error(F.concat(F.lit("no such paragraph: "), where)).cast("string"))
    bad = bad.when(~F.startswith("text", F.coalesce("anchor", F.lit(""))), F.raise_error(F.concat(F.lit("anchor does not match: "), where)).cast("string"))
    return joined.withColumn("text", bad.otherwise(F.col("text"))).select(*records.columns)


def of_paragraphs(entities: DataFrame, records: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, entities) of records (id, index): the entities (start, end and more) of a whole document that lie in their paragraph, by the
    starts (index, start, text) of its paragraphs."""
    one = starts.select(F.lit(0).alias("doc"), "index", "start", "text")
    inside = spans.bucket(entities.withColumn("doc", F.lit(0)), one, "doc").groupBy("index")
    found = inside.agg(F.array_sort(F.collect_list(F.struct("type", "start", "end"))).alias("entities"))
    empty = F.array().cast(found.schema["entities"].dataType)
    return records.select("id", "index").join(found, "index", "left").select("id", F.coalesce("entities", empty).alias("entities"))


def locate(records: DataFrame) -> DataFrame:
    """(id, text, entities) with the spans of labels, any blank matching any other. A label that is missing or overlaps another is an error."""
    one = records.select("id", "text", F.explode("labels").alias("l")).select("id", "text", "l.type", "l.occurrence", F.col("l.text").alias("_needle"))
    escaped = F.regexp_replace(F.trim("_needle"), r"([^\p{L}\p{N}\s_])", r"\\$1")
    hits = spans.matches("text", F.regexp_replace(escaped, r"(?U)\s+", r"\\s+"))
    at = F.get(hits, F.coalesce("occurrence", F.lit(1)) - 1)
    missing = F.raise_error(F.concat(F.lit("label not found: "), F.col("id"), F.lit(" "), F.col("_needle"))).cast("struct<start:int,end:int,text:string>")
    found = one.select("id", "type", F.coalesce(at, missing).alias("m")).select("id", F.struct("type", "m.start", "m.end", "m.text").alias("e"))
    by_start = F.array_sort(F.collect_list("e"), lambda a, b: (a["start"] - b["start"]))
    grouped = found.groupBy("id").agg(by_start.alias("entities"))
    clash = F.exists(F.sequence(F.lit(1), F.size("entities") - 1), lambda i: F.get("entities", i)["start"] < F.get("entities", i - 1)["end"])
    checked = grouped.select("id", F.when((F.size("entities") > 1) & clash, F.raise_error(F.concat(F.lit("labels overlap: "), F.col("id"))).cast(grouped.schema["entities"].dataType)).otherwise(F.col("entities")).alias("entities"))
    empty = F.array().cast(grouped.schema["entities"].dataType)
    return records.select("id", "text").join(checked, "id", "left").withColumn("entities", F.coalesce("entities", empty))


def _rows(side: DataFrame, name: str) -> DataFrame:
    return side.select("id", F.posexplode("entities").alias(name, "e")).select("id", name, "e.type", F.col("e.start").alias(f"{name}_start"), F.col("e.end").alias(f"{name}_end"))


def pairs(gold: DataFrame, pred: DataFrame, partial: bool = True) -> DataFrame:
    """(id, type, g, p): labels and predictions of a type paired one to one; equal spans, or the greatest overlaps first."""
    both = _rows(gold, "g").join(_rows(pred, "p"), ["id", "type"])
    over = F.least("g_end", "p_end") - F.greatest("g_start", "p_start")
    both = both.withColumn("over", over).where("over > 0" if partial else "g_start = p_start and g_end = p_end")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("over")).alias("less"), "g", "p")))
    none = F.array().cast("array<struct<less:int,g:int,p:int>>")
    keep = F.aggregate("c", none, lambda acc, x: F.when(F.exists(acc, lambda k: (k["g"] == x["g"]) | (k["p"] == x["p"])), acc).otherwise(F.array_append(acc, x)))
    per = both.groupBy("id", "type").agg(ranked.cast("array<struct<less:int,g:int,p:int>>").alias("c"))
    return per.select("id", "type", F.explode(keep).alias("k")).select("id", "type", "k.g", "k.p")


def _ratios(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    ratio = lambda a, b: F.round(F.try_divide(a.cast("double"), b), 4)
    return counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))


def scores(gold: DataFrame, pred: DataFrame, partial: bool = True) -> DataFrame:
    """type (null: all), tp, fp, fn, precision, recall, f1."""
    tally = (
        _rows(gold, "g").select("type", F.lit(0).alias("p"), F.lit(1).alias("g"), F.lit(0).alias("b"))
        .unionByName(_rows(pred, "p").select("type", F.lit(1).alias("p"), F.lit(0).alias("g"), F.lit(0).alias("b")))
        .unionByName(pairs(gold, pred, partial).select("type", F.lit(0).alias("p"), F.lit(0).alias("g"), F.lit(1).alias("b")))
    )
    counts = tally.rollup("type").agg(F.sum("b").alias("tp"), (F.sum("p") - F.sum("b")).alias("fp"), (F.sum("g") - F.sum("b")).alias("fn"))
    return _ratios(counts)


def examples(gold: DataFrame, pred: DataFrame, partial: bool = True, most: int = 8) -> DataFrame:
    """type, missed and spurious: up to `most` texts each of labels that nothing met and of predictions that met none, by id and place.

    Entities need their text. No more than `most` rows of a type leave any task."""
    met = pairs(gold, pred, partial)
    rows = lambda side, at: side.select("id", F.posexplode("entities").alias(at, "e")).select("id", at, "e.type", "e.start", "e.text").join(met.select("id", "type", at), ["id", "type", at], "left_anti")
    both = rows(gold, "g").select("type", F.lit("missed").alias("kind"), "id", "start", "text").unionByName(rows(pred, "p").select("type", F.lit("spurious").alias("kind"), "id", "start", "text"))
    first = both.withColumn("n", F.row_number().over(Window.partitionBy("type", "kind").orderBy("id", "start"))).where(F.col("n") <= most)
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("n", "text")))), lambda x: x["text"]).alias(kind)
    return first.groupBy("type").agg(listed("missed"), listed("spurious"))


def results(suites: dict[str, tuple[DataFrame, DataFrame]], config: dict) -> dict:
    """The report of several suites of (gold with text, pred): strict, partial and token scores, and examples. A row for each type at most."""
    rows = lambda df: sorted((r.asDict() for r in df.collect()), key=lambda r: str(r.get("type")))
    out = {name: {"strict": rows(scores(g, p, False)), "partial": rows(scores(g, p)), "tokens": rows(token_scores(g, p))[0], "examples": rows(examples(g, p))} for name, (g, p) in suites.items()}
    return {"config": config, "suites": out}


def token_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """tp, fp, fn, tn, ratios and accuracy over blank-separated tokens; a token counts as marked if a span covers any of it. gold has text."""
    token = gold.join(pred.select("id", F.col("entities").alias("found")), "id", "left").select("id", "entities", "found", F.explode(spans.matches("text", r"(?U)\S+")).alias("t"))

    def hit(side: str) -> Column:
        return F.coalesce(F.exists(side, lambda e: (e["start"] < F.col("t.end")) & (e["end"] > F.col("t.start"))), F.lit(False))

    g, p = hit("entities"), hit("found")
    counts = token.select(g.alias("g"), p.alias("p")).agg(F.count_if(F.expr("g and p")).alias("tp"), F.count_if(F.expr("p and not g")).alias("fp"), F.count_if(F.expr("g and not p")).alias("fn"), F.count_if(F.expr("not g and not p")).alias("tn"))
    return _ratios(counts).withColumn("accuracy", F.round(F.try_divide((F.col("tp") + F.col("tn")).cast("double"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 4))
