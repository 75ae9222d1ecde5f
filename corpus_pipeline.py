"""A corpus from quality rules to packed sequences: five stages, each on all that the last one kept.

For all stages: extra columns pass through to the last stage whatever their names; a null or
empty text is rejected by the first stage, and where a later one is given it, it stays a row of
its own; repeated rows and repeated or null ids lose nothing but what the stage says; ties go to
the least id; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import mixing, packing, quality, secrets, shingles
from siltstone.llm._cluster import drop_kept, fresh_names, keep
from siltstone.session import read_table, with_workers

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Each row is judged by itself, so repeated rows stay or go together."""
    with_workers(spark)
    (name,) = fresh_names(docs.columns, "quality")
    judged = quality.judge(docs, name=name)
    return judged.where(F.col(name)["kept"]).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more.

    The least id stays, a null id last; of repeated rows one stays; texts without words all stay.
    """
    with_workers(spark)
    return shingles.drop_near_duplicates(docs, width=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked unless many owners or repositories hold the same value.

    n_chars follows the masked text. Null texts stay null, and a null source is an owner of its own.
    """
    with_workers(spark)
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else masked


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: texts without words never, rows that share an id alike."""
    with_workers(spark)
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, placed in sequences; equal rows share their places in any order."""
    with_workers(spark)
    return packing.pack(packing.tokenize(docs))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", pack_sequences),
]

#: Tokenisation and packing are not SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written before the next one reads it."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = keep(docs, f"stage{i}")
            if before is not None:
                drop_kept(before)  # the next table is written, so nothing reads it any more
            before = docs
    return docs
