"""Exact retrieval that skips what can not enter the top k.

Lexical: chunks lie in blocks, and each block knows the largest weight that a term has in it.
Dense: vectors lie in blocks around centres, and each block knows its radius. Either way a query
first searches the blocks of its largest upper bounds; its kth score there is a threshold, and only
blocks whose bound reaches it are searched then. Results are those of the full search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.retrieval import (
    ASKED_BLOCK, CHUNK_BLOCK, QUERY_BLOCK, ROW_BLOCK, LexicalIndex, best_of_block, best_scores, deal_hot, every_block, in_blocks, matrix, numbered, top_k, weigh_lists, weighted_terms,
)
from siltstone.session import written

#: What bounds may lack by rounding.
SLACK = 1e-7


def _nth(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def threshold(scores: DataFrame, k: int, slack: float = SLACK) -> DataFrame:
    """(query_id, least): what a bound must reach to matter, for queries that have k scores."""
    kth = top_k(scores, k).where(F.col("rank") == k)
    return kth.select("query_id", (F.col("score") - slack * (1 + F.abs("score"))).alias("least"))


# ---- lexical

#: Chunks of a block, as a power of two; a query's blocks that set its threshold.
BLOCK_BITS, SEED_BLOCKS = 6, 8
#: Terms of queries that go to every task, at most.
FEW = 50_000


@dataclass
class BlockedIndex:
    """lists (block, chunk_id, len, terms, tfs) and bounds (term, block, most, n) of an index, for one k1 and b."""

    index: LexicalIndex
    lists: DataFrame
    bounds: DataFrame
    k1: float
    b: float


def build_blocks(index: LexicalIndex, k1: float = 1.5, b: float = 0.75, bits: int = BLOCK_BITS) -> BlockedIndex:
    """Chunks in blocks of 2^bits neighbours, ordered by their most frequent term and their length.

    Neighbours share a language, so that their blocks lack the terms of others, and have similar
    weights. The order is a range-partitioned sort of whole lists; no task sees more than its range.
    """
    most = F.array_max(F.arrays_zip(F.col("tfs").alias("tf"), F.col("terms").alias("term")))["term"]
    ordered = index.lists.withColumn("top", most).repartitionByRange("top", "len", "chunk_id").sortWithinPartitions("top", "len", "chunk_id")
    lists = written(ordered.select(F.shiftright(F.monotonically_increasing_id(), bits).alias("block"), "chunk_id", "len", "terms", "tfs"), "blocks")
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    # one row of totals, for all postings
    each = lists.crossJoin(F.broadcast(index.totals.select("avgdl"))).select("block", "len", "avgdl", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))))
    bounds = written(each.groupBy("term", "block").agg(F.max(weight).alias("most"), F.count(F.lit(1)).alias("n")), "bounds")
    return BlockedIndex(index, lists, bounds, k1, b)


def best_of_chosen(k: int, k1: float, b: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a group of blocks of lists the k best chunks, of scores over 0, of each query in the blocks that it has chosen.

    `asked` holds both the terms of queries (query_id, term, weight_of_term, avgdl) and their chosen
    blocks (query_id, chosen).
    """

    def best(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found = [pa.table({"query_id": asked["query_id"][:0], "chunk_id": rows["chunk_id"][:0], "score": pa.array([], pa.float64())})]
        chosen = asked.filter(pc.is_valid(asked["chosen"]))
        terms = asked.filter(pc.and_(pc.is_valid(asked["term"]), pc.is_in(asked["query_id"], chosen["query_id"].combine_chunks())))
        if rows.num_rows and terms.num_rows:
            rows = rows.sort_by([("block", "ascending"), ("chunk_id", "ascending")])
            ids, of = numbered(terms["query_id"])
            terms = terms.append_column("q", pa.array(of))
            chosen = chosen.append_column("q", pc.index_in(chosen["query_id"], ids))
            block, picked = rows["block"].to_numpy(), chosen["chosen"].to_numpy()
            for x in np.intersect1d(block, picked):
                asks = chosen.filter(pa.array(picked == x))["q"].combine_chunks().unique()
                part = rows.slice(int(np.searchsorted(block, x)), int((block == x).sum()))
                among = terms.filter(pc.is_in(terms["q"], asks))
                own, q = numbered(among["query_id"])
                for lo, scores in weigh_lists(part, among.set_column(among.schema.get_field_index("q"), "q", pa.array(q)), k1, b):
                    row, at, score = best_scores(scores.T, k)
                    over = score > 0
                    found.append(pa.table({"query_id": own.take(pa.array(row[over])), "chunk_id": part["chunk_id"].take(pa.array(at[over] + lo)), "score": pa.array(score[over])}))
        # of the blocks together, k of each query
        out = pa.concat_tables(found).combine_chunks().sort_by([("query_id", "ascending"), ("score", "descending"), ("chunk_id", "ascending")])
        _, of = numbered(out["query_id"])
        return out.filter(pa.array(np.arange(len(of)) - np.searchsorted(of, of) < k)) if out.num_rows else out

    return best


def search_lexical_pruned(blocked: BlockedIndex, queries: DataFrame, k: int = 20, negative_idf: str = "floor", seeds: int = SEED_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """The hits of search_lexical(), and (query_id, n_postings, n_read) of each query.

    n_postings is how many postings its terms have, n_read how many of them were scored in the
    second pass. Terms of negative weight count nothing in a bound, as a chunk may lack them.
    """
    wanted = written(weighted_terms(blocked.index, queries, negative_idf), "wanted")
    # blocks that hold any of a query's terms, each with what it can give at most
    few = wanted.count() <= FEW
    met = blocked.bounds.join(F.broadcast(wanted), "term") if few else deal_hot(wanted, blocked.bounds, blocked.index.terms, "block")
    bounds = met.groupBy("query_id", "block").agg(F.sum(F.greatest(F.col("weight_of_term"), F.lit(0.0)) * F.col("most")).alias("bound"), F.sum("n").alias("n"))
    bounds = written(bounds, "query-blocks")
    cores = blocked.lists.sparkSession.sparkContext.defaultParallelism
    n, n_asked = blocked.lists.count(), wanted.select("query_id").distinct().count()
    row_blocks, query_blocks = max(1, -(-n // CHUNK_BLOCK), min(cores, n)), max(1, -(-n_asked // ASKED_BLOCK))
    terms = wanted.select(every_block(row_blocks).alias("rb"), in_blocks("query_id", query_blocks).alias("qb"), "query_id", "term", "weight_of_term", "avgdl", F.lit(None).cast("long").alias("chosen"))
    kinds = {c: df.schema[c].dataType.simpleString() for c, df in (("chunk_id", blocked.lists), ("query_id", wanted))}

    def scored(chosen: DataFrame) -> DataFrame:
        """The k best of each query in each group of blocks; only lists of blocks that any query has chosen are dealt."""
        asks = chosen.select(in_blocks("block", row_blocks).alias("rb"), in_blocks("query_id", query_blocks).alias("qb"), "query_id", F.col("block").alias("chosen"))
        rows = blocked.lists.join(chosen.select("block").distinct(), "block", "left_semi")
        left = rows.select(in_blocks("block", row_blocks).alias("rb"), every_block(query_blocks).alias("qb"), "block", "chunk_id", "len", "terms", "tfs")
        right = terms.unionByName(asks, allowMissingColumns=True)
        return left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(best_of_chosen(k, blocked.k1, blocked.b), f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double")

    first = written(_nth(bounds, [F.desc("bound"), F.col("block")], "nth").where(F.col("nth") <= seeds).drop("nth"), "seeds")
    least = written(threshold(scored(first), k), "least")
    left = bounds.join(least, "query_id", "left").where(F.col("bound") > 0).where(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
    left = written(left.drop("least"), "left")
    hits = top_k(scored(left), k)
    read = bounds.groupBy("query_id").agg(F.sum("n").alias("n_postings")).join(left.groupBy("query_id").agg(F.sum("n").alias("n_read")), "query_id", "left").na.fill(0, ["n_read"])
    return hits, read


# ---- dense

#: Vectors of a cluster, about; clusters at most, and vectors the first centres are drawn from.
CLUSTER, MOST_CLUSTERS, ROUNDS = 512, 1024, 3


@dataclass
class ClusteredVectors:
    """vectors (chunk_id, embedding, block) and blocks (block, centre, radius, n)."""

    vectors: DataFrame
    blocks: DataFrame


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None] - 2 * x @ centres.T, axis=1)


def cluster_vectors(vectors: DataFrame, per_cluster: int = CLUSTER, rounds: int = ROUNDS) -> ClusteredVectors:
    """(chunk_id, embedding) dealt around centres, in blocks of ROW_BLOCK at most, about.

    At most MOST_CLUSTERS centres, first taken from the vectors in the order of a hash, then
    moved to the means of their vectors a few times. Which block a vector lies in decides how much
    is skipped, never what is found.
    """
    n = vectors.count()
    count = max(1, min(MOST_CLUSTERS, n // per_cluster))
    id_kind = vectors.schema["chunk_id"].dataType.simpleString()
    centres = np.array([r[0] for r in vectors.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(count).select("embedding").collect()], np.float64)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("embedding"))
            of = _nearest(x, centres)
            for c in np.unique(of).tolist():
                yield pa.RecordBatch.from_pydict({"c": pa.array([c], pa.int32()), "n": pa.array([int((of == c).sum())], pa.int64()), "total": [x[of == c].sum(0)]})

    for _ in range(rounds if n else 0):
        # a row a batch and centre; of each centre one row comes back
        each = vectors.select("embedding").mapInArrow(sums, "c int, n long, total array<double>")
        at = each.select("c", "n", F.posexplode("total").alias("i", "x")).groupBy("c", "i").agg((F.sum("x") / F.sum("n")).alias("x"))
        for r in at.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("mean")).collect():
            centres[r["c"]] = [m["x"] for m in r["mean"]]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("embedding"))
            of = _nearest(x, centres)
            away = np.sqrt(((x - centres[of]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of.astype(np.int32)), pa.array(away)], ["chunk_id", "embedding", "c", "away"])

    if not n:
        none = vectors.select("chunk_id", "embedding", F.lit(0).cast("long").alias("block"))
        return ClusteredVectors(none, none.select("block", F.col("embedding").cast("array<double>").alias("centre"), F.lit(0.0).alias("radius"), F.lit(0).cast("long").alias("n")))
    placed = written(vectors.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(assign, f"chunk_id {id_kind}, embedding array<double>, c int, away double"), "clusters")
    # large clusters in parts; a row a cluster
    parts = placed.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / ROW_BLOCK).alias("parts"))
    dealt = placed.join(F.broadcast(parts), "c").withColumn("block", F.col("c").cast("long") * 2**32 + F.pmod(F.xxhash64("chunk_id"), "parts"))
    blocks = dealt.groupBy("block", "c").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n"))
    known = vectors.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(centres)], "c int, centre array<double>")
    return ClusteredVectors(dealt.select("chunk_id", "embedding", "block"), written(blocks.join(F.broadcast(known), "c").select("block", "centre", "radius", "n"), "balls"))


def search_dense_pruned(clustered: ClusteredVectors, queries: DataFrame, k: int = 20, digits: int | None = None, seeds: int = 3) -> tuple[DataFrame, DataFrame]:
    """The hits of search_dense(), and (query_id, n_vectors, n_met) of each query.

    A block gives at most the product with its centre plus radius times the query's length.
    n_met counts the vectors that the query was multiplied with in the second pass.
    """
    asked = written(queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")), "asked")
    kind = asked.schema["query_id"].dataType.simpleString()
    n_blocks, n_asked = clustered.blocks.count(), asked.count()
    ball_parts, query_parts = max(1, -(-n_blocks // ROW_BLOCK)), max(1, -(-n_asked // QUERY_BLOCK))

    def bound(balls: pa.Table, q: pa.Table) -> pa.Table:
        if not balls.num_rows or not q.num_rows:
            return pa.table({"query_id": q["query_id"][:0], "block": balls["block"][:0], "bound": pa.array([], pa.float64()), "n": balls["n"][:0]})
        x = matrix(q["embedding"])
        most = x @ matrix(balls["centre"]).T + np.sqrt((x**2).sum(1))[:, None] * balls["radius"].to_numpy()[None]
        of, at = np.divmod(np.arange(most.size), balls.num_rows)
        return pa.table({"query_id": q["query_id"].take(pa.array(of)), "block": balls["block"].take(pa.array(at)), "bound": most.ravel(), "n": balls["n"].take(pa.array(at))})

    left = clustered.blocks.select(in_blocks("block", ball_parts).alias("bb"), every_block(query_parts).alias("qb"), "block", "centre", "radius", "n")
    right = asked.select(every_block(ball_parts).alias("bb"), in_blocks("query_id", query_parts).alias("qb"), "query_id", "embedding")
    bounds = written(left.groupBy("bb", "qb").cogroup(right.groupBy("bb", "qb")).applyInArrow(bound, f"query_id {kind}, block long, bound double, n long"), "query-balls")

    def scored(chosen: DataFrame) -> DataFrame:
        """The k best of each query in each chosen block; queries of one block in parts of QUERY_BLOCK, about."""
        parts = chosen.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("parts"))
        v = clustered.vectors.join(parts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "chunk_id", "embedding")
        q = chosen.select("query_id", "block").join(parts, "block").join(asked, "query_id").select("block", F.pmod(F.xxhash64("query_id"), "parts").cast("int").alias("part"), "query_id", "embedding")
        id_kind = clustered.vectors.schema["chunk_id"].dataType.simpleString()
        return v.groupBy("block", "part").cogroup(q.groupBy("block", "part")).applyInArrow(best_of_block(k, digits), f"query_id {kind}, chunk_id {id_kind}, score double")

    first = written(_nth(bounds, [F.desc("bound"), F.col("block")], "nth").where(F.col("nth") <= seeds).drop("nth"), "seeds")
    seen = written(scored(first), "seed-scores")
    least = threshold(seen, k, SLACK if digits is None else max(SLACK, 10.0**-digits))
    left_over = bounds.join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") + SLACK >= F.col("least")))
    left_over = written(left_over.drop("least"), "left")
    rest = left_over.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti")
    hits = top_k(seen.unionByName(scored(rest)), k)
    met = bounds.groupBy("query_id").agg(F.sum("n").alias("n_vectors")).join(left_over.groupBy("query_id").agg(F.sum("n").alias("n_met")), "query_id", "left").na.fill(0, ["n_met"])
    return hits, met
