"""A corpus pipeline of five stages over documents. run() applies them in order; each works on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Nulls,
empty texts, repeated rows, extra columns and empty tables are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkveil.llm import bpe, decontam, linededup, quality, simhash
from inkveil.llm.common import table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that 10 or more of them have; n_chars follows the text, documents stay even if left empty, null texts stay null."""
    return linededup.rewrite(docs, n_chars="n_chars")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return simhash.keep_one(docs)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded: the tokens of each document, and the text that they decode to."""
    return bpe.tokens_and_text(docs.select("doc_id", "text"))


STAGES = [
    ("quality classifier", good),
    ("line dedup", fresh_lines),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", unleaked),
    ("BPE encoding and decoding", tokenized),
]
#: SQL cannot express the classifier, the near-dedup and the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
