"""Redaction of streams. A document that comes whole needs no state, so output is append and needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from inkveil.operators import engine
from inkveil.settings import Settings


def stream(docs: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """A streaming DataFrame with entities, redacted and mapping; the same operator as in a batch."""
    if not docs.isStreaming:
        raise ValueError("not a streaming DataFrame")
    return engine.detect(docs, settings, text)


def run(spark: SparkSession, source: str, schema: str, target: str, settings: Settings = Settings(), text: str = "text", once: bool = False, checkpoint: str | None = None) -> StreamingQuery:
    """Redacts Parquet files as they arrive in source and appends them to target, without their original text.

    checkpoint (shared by the cluster; by default below target) makes a restart go on where the last run stopped, each file once.
    """
    found = stream(spark.readStream.schema(schema).parquet(source), settings, text)
    out = found.drop(text).withColumnRenamed("redacted", text).drop("mapping")
    writer = out.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint or f"{target}/_checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()
