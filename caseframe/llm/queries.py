"""One query for each operator, over its whole table with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseframe.llm import decontamination, divergence, lines, near_dup, packing, pii, pivots, quality, sharding, substrings, token_store, toxicity, whitening
from caseframe.llm.common import shared_folder, table


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = map(_count, pii.KINDS)
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"), F.size("spans").cast("long").alias("n_all"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/caseframe/store-{uuid.uuid4().hex}"
    token_store.write_store(table(spark, sf_dir, "documents"), folder)
    return token_store.verify_store(spark, folder)


def op3_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op4_weighted_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), rising=True, edited=True)


def op5_pivot_permutation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.link(table(spark, sf_dir, "embeddings"))


def op6_weak_supervision_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_ngram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    named = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), named.alias("items_sha256"), "contaminated")


def op10_perfect_hash_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_crf": op1_pii_crf,
    "op2_token_store": op2_token_store,
    "op3_label_propagation_shards": op3_label_propagation_shards,
    "op4_weighted_minhash_near_dup": op4_weighted_minhash_near_dup,
    "op5_pivot_permutation_links": op5_pivot_permutation_links,
    "op6_weak_supervision_toxicity": op6_weak_supervision_toxicity,
    "op7_suffix_tree_dedup": op7_suffix_tree_dedup,
    "op8_bin_slack_packing": op8_bin_slack_packing,
    "op9_ngram_decontamination": op9_ngram_decontamination,
    "op10_perfect_hash_line_dedup": op10_perfect_hash_line_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_fourier_quality": op12_fourier_quality,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op5_pivot_permutation_links": pivots.ORACLE,
    "op7_suffix_tree_dedup": substrings.ORACLE,
    "op9_ngram_decontamination": decontamination.ORACLE,
    "op10_perfect_hash_line_dedup": lines.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
