"""Registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..paths import new_path
from .bpe import joined_ids, round_trip
from .common import table
from .html_text import extract_pages
from .license_scan import scan
from .ngram_join import jaccard_components
from .oracles import ORACLES as ORACLES
from .packing import pack_documents
from .quality_classifier import classify
from .quality_rules import ablation, apply_policy, ledger, store_ledger
from .sharding import shard
from .spotsigs import fingerprints
from .substring_dedup import substring_dedup


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Name of the tokenizer file in the installed package of public vocabularies.
TOKENIZER = "byte_bpe_50k.json"


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op3_spotsigs_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"file://{public_tokenizers.path(TOKENIZER)}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = round_trip(docs, path)
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(joined_ids("ids"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op2_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), buckets=16, budget=65536)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_policy(ledger(table(spark, sf_dir, "documents")), "strict@2")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def quality_rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the newest policy decides, from the stored ledger of all documents."""
    return ablation(store_ledger(table(spark, sf_dir, "documents"), new_path(spark, "ledger")), "strict@2")


def op8_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), shards=8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_length_packing": op2_length_packing,
    "op3_spotsigs_fingerprints": op3_spotsigs_fingerprints,
    "op4_bpe_encoding": op4_bpe_encoding,
    "op5_html_extraction": op5_html_extraction,
    "op6_license_scan": op6_license_scan,
    "op7_quality_rules": op7_quality_rules,
    "op8_rendezvous_sharding": op8_rendezvous_sharding,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "quality_rules_ablation": quality_rules_ablation,
}
