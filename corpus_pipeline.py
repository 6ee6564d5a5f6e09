"""The training-data pipeline over the documents table: language ID, line dedup, n-gram Jaccard join, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the shared folder and reads
again as the next stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, language, linededup, packing, store


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null or without any letter) go; the others stay as they are, repeated rows and null ids too.

    The model learns from the labelled documents that arrive here, but for the held-out quarter."""
    model = language.fit(docs.where(language.remainder(4) != 2))
    found = tuple(store.fresh(docs.columns, "lang_pred", "lang_score", "n_words"))
    return language.predict(docs, model, docs.columns, found).where(F.col(found[2]) > 0).select(*(f"`{x}`" for x in docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-equal lines stay once in the corpus; a document goes when all its lines are repeats. n_chars follows the text.

    Of rows with one doc_id and one text all stay alike; null ids and one id with several texts are told apart by the text."""
    lines, dropped = store.fresh(docs.columns, "n_lines", "n_dropped")
    found = linededup.dedup_lines(docs, (lines, dropped)).where((F.col(dropped) == 0) | (F.col(lines) > F.col(dropped)))
    return found.withColumn("n_chars", F.when(F.col(dropped) == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*(f"`{x}`" for x in docs.columns))


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays; documents without words or without an id stay.

    A row goes by its doc_id and text: another text of the same id has a fate of its own."""
    key, row = store.fresh(docs.columns, "gone_id", "gone_row")
    gone = jaccard.near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias(key), F.col("row").alias(row))
    return docs.join(gone.hint("merge"), (docs["doc_id"].cast("long") == gone[key]) & (jaccard.row_hash(docs["text"]) == gone[row]), "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of binary length, each filling a sequence of its own length, equal lengths together, with their token ids; every row is packed, as it comes."""
    return packing.pack(docs, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", duplicate_stage),
    ("packing", packing_stage),
]

#: Segmentation marginals, MinHash candidates and BPE are beyond SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, store.materialise(stage(spark, docs, sf_dir), name)
        store.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
