"""What the operators share about running on a cluster: cut points, ranks under skew, hashes."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.session import with_workers


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); in local mode one of our own where that is unset.

    A folder of this machine would lose tables on a cluster, whose executors each write to their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as a Parquet table into the shared folder and read it back.

    Cuts the lineage: a lost executor repeats only the tasks after the table, and what is
    used twice is computed once.
    """
    spark = with_workers(df.sparkSession)
    path = f"{shared_dir(spark)}/siltstone-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Ask the driver to notice which shuffles nothing needs any more, so that their files go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_kept(df: DataFrame) -> None:
    """Delete the table behind a frame made by keep(), once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def n_buckets(spark: SparkSession, factor: int = 4) -> int:
    """Buckets into which a group is dealt so that no task gets a hot group whole."""
    return factor * int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], buckets: int, name: str) -> DataFrame:
    """Adds `name`: 0, 1, 2, ... within `keys`, without bringing a group into one task.

    A row's bucket is a hash of its order columns. Rows are numbered inside (keys, bucket);
    a bucket starts after the rows of the buckets before it. `df` is read twice, so it should
    be a kept table; the order columns should tell rows apart, else equal rows share the
    numbers among themselves in any order.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col("__bucket").alias("__b"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
    )
    local = dealt.withColumn("__local", F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(*order)) - 1)
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    joined = local.join(starts, [*on, F.col("__bucket") == F.col("__b")], "left")
    return joined.select(*df.columns, (F.col("__start") + F.col("__local")).cast("long").alias(name))


def with_counts(rows: DataFrame, counts: DataFrame, key: str, uses: str, parts: int) -> DataFrame:
    """`rows` joined with `counts` (one row per `key`, of which `uses` says how many rows have it).

    Keys with more than one of `parts` shares of all rows number fewer than `parts`; those are
    broadcast, so that their rows stay where they are. The others are joined by a shuffle. Both
    frames are read twice, so they should be kept tables.
    """
    total = counts.agg(F.sum(uses)).first()[0] or 0
    least = max(1, total // parts)
    hot = F.broadcast(counts.where(F.col(uses) > least))
    rest = rows.join(hot.select(key), key, "left_anti").join(counts.where(F.col(uses) <= least), key)
    return rows.join(hot, key).unionByName(rest)


def fresh_names(columns: Sequence[str], *stems: str) -> list[str]:
    """The stems as column names that `columns` do not have."""
    taken = {c.lower() for c in columns}
    out = []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def crc_mod(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(modulus))
