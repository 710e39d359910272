"""A training-data pipeline over documents: each stage is written as Parquet and read by the next one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.exact_dedup import exact_dedup
from quire.llm.ngram_join import one_of_each
from quire.llm.packing import pack
from quire.llm.quality_classifier import quality
from quire.llm.queries import tokenizer_path
from quire.llm.toxicity import toxicity
from quire.plans.staging import stage


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 for toxicity, with docs' own columns.

    A null, empty or blank text scores as the least toxic does and stays; repeated rows go or stay
    together; a row without an id is scored like any other.  An empty table gives no rows.
    """
    return toxicity(docs, _labels(spark, sf_dir)).where("predicted = 0").select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more for quality, with docs' own columns.

    A null, empty or blank text is scored as a text without words; repeated rows go or stay
    together; a row without an id is scored like any other.  An empty table gives no rows.
    """
    return quality(docs, _labels(spark, sf_dir)).where("predicted = 1").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text without its blanks, with docs' own columns.

    Null, empty and blank texts are one text.  The longest original stays, then the smallest id (none
    comes last), and one of rows that repeat both.  An empty table gives no rows.
    """
    return exact_dedup(docs).where("kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity lead to, the one of the smallest doc_id, with docs' own columns.

    A document without an id stays only if no linked one has an id; of rows that repeat id and text
    one stays.  Null, empty and blank texts have no links and stay.  An empty table gives no rows.
    """
    return one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces in sequences of 1024 tokens.

    A null or empty text is one piece of the closing id; a long one is cut as needed; rows that repeat or have
    no id are documents of their own.  Columns of docs are left out.  An empty table gives no pieces.
    """
    out = pack(docs, tokenizer_path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("packing", packed),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
