"""Detection in SQL: SELECT * FROM docs, LATERAL find_entities(text), and redact_text(text)."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from inkveil.operators import engine
from inkveil.settings import Settings

COLUMNS = "type string, start int, end int, text string, recognizer string, score double, notes string"


def register(spark: SparkSession, settings: Settings = Settings(), more: list[engine.Detector] = ()) -> None:
    """Registers find_entities (a table function) and redact_text (a scalar one) in the session."""

    class FindEntities:
        def eval(self, text: str):
            for kind, start, end, name, score, notes in engine.analyze(text, settings, more) if text else ():
                yield kind, start, end, text[start:end], name, round(score, 3), notes

    def redact_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([engine.rewrite(t, engine.analyze(t, settings, more), settings.seed)[0] if t else t for t in texts], dtype=object)

    spark.udtf.register("find_entities", F.udtf(FindEntities, returnType=COLUMNS))
    spark.udf.register("redact_text", F.pandas_udf("string")(redact_text))
