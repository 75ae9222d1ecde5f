"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots and posted, with their ranks, in
the inverted files of those pivots. A query gathers the postings of its own pivots and ranks the
vectors by (induced) footrule distance between the orders. Rows lie in blocks by a hash of the
vector, each with inverted files of its own; every block of queries meets every block of rows, so
each group a task holds is bounded and every row is indexed. A block passes on its best rows by
footrule, ids and ranks only; of all blocks together a query keeps as many as are asked for,
whatever the number of rows, and only those are joined with their vectors and reranked exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm._cluster import keep

#: Pivots (the bounded sample the index is fitted on) and how many of them represent a vector.
PIVOTS, PREFIX = 1024, 256
#: Rows that a query reranks exactly. Each block passes on its part of them and four standard
#: deviations more, as the best rows are dealt over blocks by chance.
CANDIDATES = 384
ROW_BLOCK, QUERY_BLOCK = 8192, 1024


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    values = np.asarray(flat.flatten(), dtype=np.float64)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 0)


def orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The `prefix` nearest pivots of each vector, nearest first, ties to the lower number."""
    distance = (pivots**2).sum(1)[None] - 2 * vectors @ pivots.T
    return np.argsort(distance, axis=1, kind="stable")[:, :prefix].astype(np.int32)


def of_block(candidates: int, rows: int, all_rows: int) -> int:
    """How many of a block's `rows` it passes on for a query: all `candidates` where it is the only block."""
    share = rows / max(all_rows, 1)
    return min(rows, math.ceil(candidates * share + 4 * math.sqrt(candidates * share * (1 - share))))


class InvertedFiles:
    """Postings (row, rank) of a block of vectors, by pivot."""

    def __init__(self, order: np.ndarray, n_pivots: int):
        self.rows, self.prefix = order.shape
        by_pivot = np.argsort(order.ravel(), kind="stable")
        self.row, self.rank = by_pivot // self.prefix, (by_pivot % self.prefix).astype(np.int32)
        self.start = np.searchsorted(order.ravel()[by_pivot], np.arange(n_pivots + 1))

    def nearness(self, order: np.ndarray) -> np.ndarray:
        """prefix * (prefix + 1) less the footrule distance to each row, up to a constant.

        A pivot outside a vector's prefix counts as if its rank were the prefix length.
        """
        total = np.zeros(self.rows, np.int32)
        for rank, pivot in enumerate(order):
            at = slice(self.start[pivot], self.start[pivot + 1])
            # what both sides are charged for a missing pivot, less the difference of their ranks:
            # (prefix - rank) + (prefix - other) - |rank - other|
            total[self.row[at]] += 2 * (self.prefix - np.maximum(self.rank[at], rank))
        return total


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    pivots: int = PIVOTS,
    prefix: int = PREFIX,
    candidates: int = CANDIDATES,
) -> DataFrame:
    """The `k` nearest found rows of `vectors` for each row of `queries`: query_id, rank, vec_id, score.

    score is the Euclidean distance in double precision, ranks from 1, ties to the smaller id;
    a query's own id is no candidate; all candidates are returned if fewer. Ids must be whole
    numbers. Rows take no part if the id or vector is null, a component is null or not finite,
    the vector is zero, or its length is not the most common one (of those, the longer). Rows
    that repeat id and vector count once; equal vectors are indexed once and share postings.
    A query id with several vectors gets the nearest to any. Empty tables give empty results.
    """

    def usable(df: DataFrame) -> DataFrame:
        x = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
        fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))) & F.exists("v", lambda c: c != 0)
        return x.where(fine)

    rows = usable(vectors)
    out = "query_id long, rank int, vec_id long, score double"
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], out)
    dim = sizes["dim"]
    # Equal vectors: the k + 1 smallest ids are all that can be returned for any query.
    smallest = Window.partitionBy("v").orderBy("id")
    ranked = rows.where(F.size("v") == dim).withColumn("nth", F.dense_rank().over(smallest)).where(F.col("nth") <= k + 1)
    classes = ranked.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("row", F.get("ids", F.lit(0)))
    # a vector that repeats under an id would share its least id; (row, h) names each class
    classes = keep(classes.withColumn("h", F.xxhash64("v")), "vectors")
    asked = keep(usable(queries).where(F.size("v") == dim).distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    centre = np.array([r[0] for r in classes.orderBy("h", "v").limit(pivots).select("v").collect()], dtype=np.float64)
    n_rows, n_asked = classes.count(), asked.count()
    row_blocks, query_blocks = -(-n_rows // ROW_BLOCK), max(1, -(-n_asked // QUERY_BLOCK))
    width = min(prefix, len(centre))

    def ranked_by_footrule(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 4]
        if left.num_rows and right.num_rows:
            row, h, q = (t[c].to_numpy() for t, c in ((left, "row"), (left, "h"), (right, "q")))
            files, order = InvertedFiles(orders(_matrix(left["v"]), centre, width), len(centre)), orders(_matrix(right["v"]), centre, width)
            most = of_block(candidates, left.num_rows, n_rows)
            for i, me in enumerate(q):
                near = files.nearness(order[i])
                best = np.argpartition(-near, most - 1)[:most] if most < len(row) else np.arange(len(row))
                found.append((np.full(len(best), me), row[best], h[best], near[best].astype(np.int64)))
        q, row, h, near = (np.concatenate([f[j] for f in found]) for j in range(4))
        return pa.table({"q": q, "row": row, "h": h, "near": near})

    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = classes.select(block("v", row_blocks).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), "v", "row", "h")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"), block("id", query_blocks).alias("qb"), "v", "q")
    met = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(ranked_by_footrule, "q long, row long, h long, near long")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "row", "h"))
    chosen = keep(met.withColumn("nth", nth).where(F.col("nth") <= max(candidates, k + 1)).select("q", "row", "h"), "candidates")
    pairs = chosen.join(classes.select("row", "h", "v", "ids"), ["row", "h"]).join(asked.select("q", F.col("id").alias("query_id"), F.col("v").alias("qv")), "q")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = np.sqrt(((_matrix(batch.column("v")) - _matrix(batch.column("qv"))) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("ids"), pa.array(away)], ["query_id", "ids", "score"])

    scored = pairs.select("query_id", "ids", "v", "qv").mapInArrow(exact, "query_id long, ids array<long>, score double")
    each = scored.select("query_id", F.explode("ids").alias("vec_id"), "score").where(F.col("vec_id") != F.col("query_id"))
    best = each.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6(embeddings: DataFrame) -> DataFrame:
    """The contract's search: rows whose id is divisible by 100 against all others."""
    return nearest(embeddings, embeddings.where(F.col("vec_id") % 100 == 0))
