"""Corpus pipeline over ``documents``: each stage is written as Parquet and read again by the next.

1. quality: documents that the classifier rejects go;
2. exact dedup: of equal texts one document stays;
3. near dedup: of each class of near-duplicates one document stays;
4. decontamination: documents with a window of a benchmark item go;
5. tokens: the ids of each remaining document.

All stages but the last return the columns of ``documents``. Rows that repeat a doc_id are told apart by
their place, never by the id. An empty table passes all stages. A stage deletes what the one before has staged on
its way, so write each result before the next stage is called. ``ORACLE_SQL`` is None: a learnt model, near-duplicates and BPE are not SQL.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparcel.llm import bpe, quality
from sparcel.llm.decontaminate import contamination
from sparcel.llm.exact_dedup import drop_copies
from sparcel.llm.near_dedup import drop_near_copies
from sparcel.llm.queries import GOOD, quality_model
from sparcel.session import release_staged, stage, staged_since


def frugal(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Deletes what the stage before has staged for itself: its result is written by now."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_staged(spark, SPENT)
        with staged_since() as made:
            result = function(spark, docs, sf_dir)
        SPENT.extend(made)
        return result

    return run_stage


#: Tables that the last stage staged on its way, not its result.
SPENT: list[str] = []


@frugal
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is high enough, null and empty texts by their own score; rows that repeat are judged alike.

    The score stands beside each row, so no join is needed.
    """
    name = "score"
    while name in docs.columns:
        name += "_"
    return quality.with_score(docs, quality_model(spark, sf_dir, docs), name).filter(F.col(name) >= GOOD).select(*[F.col(f"`{c}`") for c in docs.columns])


@frugal
def different_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id, a null one being the smallest; null equals empty."""
    return drop_copies(docs)


@frugal
def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest doc_id, a null one being the largest.

    Documents without words (null, empty) are near-duplicates of none.
    """
    return drop_near_copies(docs)


@frugal
def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; those without words stay."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")  # one column: no name of a field clashes
    rows = stage(docs.select(whole, F.monotonically_increasing_id().alias("row")), "numbered")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(rows.select(F.col("row").alias("doc_id"), "doc.text"), benchmark)
    hit = found.filter("contaminated").select(F.col("doc_id").alias("row"))
    return rows.join(hit, "row", "left_anti").select("doc.*")


@frugal
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and the text they decode to, of every row; null counts as empty."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded=True)


STAGES = [
    ("quality", good_documents),
    ("exact dedup", different_documents),
    ("near dedup", distinct_documents),
    ("decontamination", clean_documents),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
