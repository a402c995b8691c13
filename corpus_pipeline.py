"""A training corpus from raw documents: each stage works on all that the one before kept, written and read again.

toxicity: documents predicted toxic go. line dedup: lines that three or more documents share stay in one of them.
MinHash near-dedup: one document of each group of near duplicates stays. decontamination: documents that hold a benchmark
window go. packing: the pieces of the documents that are left, in sequences of at most 4,096 tokens.

Null texts count as empty and stay null. Rows without doc_id pass the filtering stages and are left out by packing. Of rows that repeat
a doc_id, toxicity, near-dedup and decontamination drop all if they name the doc_id; line dedup and packing treat each. Other
columns, whatever their names, are carried along by all stages but packing. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caseframe.llm import decontamination, lines, near_dup, packing, toxicity
from caseframe.llm.common import Written, drop_all, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with what is left of their text; a document that loses all lines stays, empty."""
    return lines.without_repeated_lines(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs, rising=True, edited=True)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_near),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: SQL can't express the classifier or the sampled near duplicates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each other stage's documents are a table in the shared folder, freed when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        after = Written(out, "pipeline")
        drop_all(before)
        docs, before = after.df, after
