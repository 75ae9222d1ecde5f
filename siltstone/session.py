"""Session defaults, table access and what every job needs from the cluster."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "siltstone", **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow transfer and UTC times; `conf` overrides."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    builder = SparkSession.builder.appName(app)
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    return with_workers(builder.getOrCreate())


def with_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver found it.

    On a cluster the package is installed or sent with --py-files; in local mode and on
    machines that share the checkout this saves setting PYTHONPATH by hand.
    """
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([*parts, root])
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table by name; works with any path that Spark's readers open."""
    return with_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """`df`, dealt over the cores by `key` if Spark would read it in one task.

    That is a file of one row group, which can not be split; tables of more are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if cores > 1 and df.rdd.getNumPartitions() == 1 else df


def parts_for(spark: SparkSession, size: int, each: int) -> int:
    """In how many parts a table of `size` is dealt so that none is much over `each`; as many as shuffles have at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


#: Characters of text, about, that a Python worker holds at a time beside the batch it was sent.
SLICE = 1_000_000


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """`batch` in parts of at most `most` characters of a column of strings; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, start = np.concatenate([[0], np.cumsum(sizes)]), 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(upto, upto[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder (spark.checkpoint.dir).

    In local mode a folder of its own stands in where the setting is unset; on a cluster that
    would be a folder of one machine, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/siltstone-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back.

    What is used several times is computed once, and a lost executor repeats only what comes
    after the table.
    """
    spark = with_workers(df.sparkSession)
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
