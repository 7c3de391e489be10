"""The corpus pipeline: quality classifier, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
before the next. All but the last keep the columns of documents, whatever further columns there are and however
they are named. In every stage a null text counts as an empty one, a null doc_id is a document of its own text,
very long texts are worked on whole, and an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm.common import stored, table
from quantloom.llm.op4_line_dedup import without_repeats
from quantloom.llm.op5_quality import accepted
from quantloom.llm.op8_decontamination import clean
from quantloom.llm.op9_bpe import tokenize
from quantloom.llm.op10_dartminhash import keep_one
from quantloom.llm.queries import tokenizer_path
from quantloom.ship import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; it learns from the labels of the documents it is given.

    Repeated rows share a score and a fate. Without labels of both kinds every document has the share of good
    labels as its score (one half without any), and goes with it.
    """
    ship(spark)
    return accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of aligned common blocks go from the texts; all rows stay.

    Null texts stay null. Rows of equal doc_id and text are one document and stay as they are; of equal
    ids with different texts, the digest of the text decides which is earlier; rows without doc_id are the latest.
    """
    ship(spark)
    return without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: that with the smallest doc_id, then digest of the text.

    Null, empty and wordless texts are in the class of their own text. Of repeated rows one stays.
    """
    ship(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go; texts without words stay, repeated rows share a fate.

    An empty benchmark contaminates nothing.
    """
    ship(spark)
    return clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the documents' tokens: a row per row; null and empty texts have no tokens."""
    ship(spark)
    return tokenize(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The stages hold a trained network, alignments and a tokenizer, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
