"""A training corpus in five stages, each on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm import language_id as lid
from sedge.llm.bpe import bpe_digests
from sedge.llm.common import table, written
from sedge.llm.decontaminate import decontaminate
from sedge.llm.exact_dedup import unique_rows
from sedge.llm.jaccard_join import unlike_rows

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: those with a null or empty text or no letter, which are `und`. A document
    without a label gets the language it is told by; labels stay. Where no row has both text and label there is no
    model, and every document with a letter stays as it is. Repeated rows are told alike; null identifiers don't matter."""
    model = lid.fit(docs, "doc_id", "text", "lang")
    if model is None:
        return docs.select(*COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    told = lid.predict(docs.select(*COLUMNS), model, "doc_id", "text", COLUMNS)
    return told.where(told.lang_pred != lid.UNDETERMINED).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def unique_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays, a null one last; of rows that repeat text and doc_id one;
    a null text counts as empty."""
    return unique_rows(docs.select(*COLUMNS))


def unlike_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near likeness, directly or over others, the one with the smallest doc_id stays; documents
    without words or without doc_id stay, and rows that repeat a doc_id stay or go together."""
    return unlike_rows(docs.select(*COLUMNS))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a passage of the benchmark, those without doc_id too; rows without a text stay."""
    return decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left; a null text counts as empty."""
    return bpe_digests(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify),
    ("exact_dedup", unique_texts),
    ("near_dedup", unlike_texts),
    ("decontaminate", uncontaminated),
    ("bpe", encode),
]

#: SQL can express neither the classifier nor the vocabulary; the tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
