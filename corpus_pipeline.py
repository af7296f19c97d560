"""Corpus pipeline: from `documents` to packed, clean and deduplicated training texts.

Stages hand tables with the columns of `documents` on, and any further columns, whatever their names; each decides over all rows
its predecessor kept. The last one returns the batches. Defined results: null, empty and blank texts are judged as such and fail the
rules; rows with a null doc_id pass filters like others, are linked with nothing and stay apart; of repeated rows (equal doc_id
and text) one stays; different texts of one doc_id are one node of the near-duplicate groups, and stay or go together; an empty
table gives no rows at every stage, and a table without labels leaves all to the rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import only, table, without, written
from loam.llm.ngram_join import jaccard_components
from loam.llm.packing import pack_documents
from loam.llm.quality_classifier import classify
from loam.llm.quality_rules import keep
from loam.llm.substring_dedup import substring_dedup_rows

#: No SQL expresses the first stage's fitted model; tests hold each stage against a brute-force version instead.
ORACLE_SQL: str | None = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier predicts to be good."""
    own = ("__held_out", "__score", "__predicted")
    return classify(docs, table(spark, sf_dir, "labels"), names=own).where("__predicted = 1").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no rule of the policy fails."""
    return keep(docs, "strict@2")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id, and of its repeated rows one."""
    groups = jaccard_components(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    kept = without(docs, written(groups, "dropped"))
    again = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id")
    again = written(again, "repeated")
    if again.isEmpty():
        return kept
    return without(kept, again).unionByName(only(kept, again).dropDuplicates(["doc_id", "text"]))


def substring_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand in an earlier document; texts that lose nothing stay as they are, emptied ones go."""
    return substring_dedup_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of padded rows: doc_id, n_tokens, bucket, boundary, batch, slot."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substring_duplicates),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's table is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
