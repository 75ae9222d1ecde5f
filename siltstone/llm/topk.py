"""Exact inner-product top-k by distributed selection on histograms.

All scores are computed block against block. Each round counts, for every query, how many
scores fall into each of BINS equal ranges of values; the counts of all blocks are added and
the range that holds the kth score is divided again, until it is one value. A last pass
returns what lies above that value and, of what equals it, the smallest ids that are wanted.
Only counts, at most k a block and query, and the final rows are shuffled, never scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm._cluster import keep, let_go

#: Ranges a round divides a range of scores into: 2^BITS.
BITS = 10
BINS = 1 << BITS
#: Rows and queries of a block at most, and scores computed at a time.
ROW_BLOCK, QUERY_BLOCK, AT_ONCE = 16_384, 4096, 1 << 21
#: Query blocks of up to so many bytes in all are broadcast; others are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
_LONG = 2**63 - 1


def quantised(vectors: np.ndarray, factor: float) -> np.ndarray:
    """floor(factor * x); a product beyond doubles counts as the largest double."""
    top = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors * factor), -top, top)


def _pack(key: str, factor: float):
    """Packs a block's rows into one: ids and quantised vectors, by id."""

    def pack(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        flat = pa.concat_arrays(table["v"].chunks).flatten().to_numpy(zero_copy_only=False)
        values = quantised(flat.reshape(len(ids), -1), factor)
        order = np.lexsort((*values.T[::-1], ids))
        most = float(np.abs(values).max(initial=0))
        # whole numbers under 2^15 are kept as such
        kind = "<i2" if most < 2**15 else "<f8"
        return pa.table({key: table[key][:1], "n": pa.array([len(ids)], pa.int32()), "ids": [ids[order].astype("<i8").tobytes()], "kind": [kind], "most": [most], "data": [values[order].astype(kind).tobytes()]})

    return pack


_BLOCK = "{key} int, n int, ids binary, kind string, most double, data binary"


def _unpack(ids: bytes, data: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(data, kind).astype(np.float64).reshape(len(i), -1)


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers; exact, those beyond 64 bits count as the nearest.

    Doubles hold them exactly as long as no sum can reach 2^53; others take Python's integers.
    """
    dim = queries.shape[1]
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(dim, 1)
    if bound < 2**53:
        return (queries @ rows.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(queries).astype(object) @ whole(rows).astype(object).T
    return np.frompyfunc(lambda x: max(-_LONG, min(_LONG, x)), 1, 1)(exact).astype(np.int64)


def _parts(row: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first query, row ids, scores, own) of a pair of blocks; own marks the query's own id."""
    ids, rows = _unpack(row["ids"], row["data"], row["kind"])
    asked, queries = _unpack(row["q_ids"], row["q_data"], row["q_kind"])
    step = max(1, AT_ONCE // max(len(ids), 1))
    for i in range(0, len(asked), step):
        yield i, ids, products(queries[i : i + step], rows), ids[None] == asked[i : i + step, None]


def top_bins(counts: np.ndarray, k: int) -> np.ndarray:
    """Which bins of each row hold any of its k highest: those with a count and fewer than k above."""
    above = np.cumsum(counts[:, ::-1], 1)[:, ::-1] - counts
    return (counts > 0) & (above < k)


def _count(low: int, before: int | None, bits: int, k: int):
    """Counts of a pair of blocks by query and range of 2^bits scores, in the range of 2^before found last."""

    def count(pair: pa.Table) -> pa.Table:
        row = pair.to_pylist()[0]
        found = np.frombuffer(row["found"], "<i8") if before is not None else np.zeros(row["q_n"], np.int64)
        parts: list[tuple[np.ndarray, ...]] = []
        for i, _, scores, own in _parts(row):
            # above the least possible score, which fits 64 bits without a sign
            height = scores.astype(np.uint64) - np.uint64(low % 2**64)
            place = found[i : i + len(scores), None].astype(np.uint64)
            fits = ~own if before is None else ~own & (height >> np.uint64(before) == place)
            bins = (height >> np.uint64(bits)) & np.uint64(BINS - 1)
            flat = (np.arange(len(scores), dtype=np.int64)[:, None] * BINS + bins.astype(np.int64))[fits]
            counts = np.bincount(flat, minlength=len(scores) * BINS).reshape(len(scores), BINS)
            q, b = np.nonzero(top_bins(counts, k))
            parts.append((q + i, b, counts[q, b]))
        q, b, n = (np.concatenate([p[j] for p in parts] or [np.zeros(0)]) for j in range(3))
        return pa.table({"qb": pa.array(np.full(len(q), row["qb"]), pa.int32()), "qi": pa.array(q.astype(np.int32)), "bin": pa.array(b.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    return count


def _take(pair: pa.Table) -> pa.Table:
    """What scores above the kth value, and the smallest ids of what equals it."""
    row = pair.to_pylist()[0]
    last, wanted = np.frombuffer(row["found"], "<i8"), np.frombuffer(row["wanted"], "<i8")
    asked = np.frombuffer(row["q_ids"], "<i8")
    parts: list[tuple[np.ndarray, ...]] = []
    for i, ids, scores, own in _parts(row):
        here = slice(i, i + len(scores))
        equal = (scores == last[here, None]) & ~own
        some = equal & (np.cumsum(equal, 1) <= wanted[here, None])
        q, r = np.nonzero(((scores > last[here, None]) & ~own) | some)
        parts.append((asked[q + i], ids[r], scores[q, r]))
    q, r, s = (np.concatenate([p[j] for p in parts] or [np.zeros(0)]).astype(np.int64) for j in range(3))
    return pa.table({"query_id": q, "vec_id": r, "score": s})


def _state(table: pa.Table) -> pa.Table:
    """A query block's places and wanted numbers in the order of its queries, 0 for those without."""
    packed = {}
    for name in ("place", "wanted"):
        values = np.zeros(table["n"][0].as_py(), "<i8")
        values[table["qi"].to_numpy()] = table[name].to_numpy()
        packed[name] = [values.tobytes()]
    return pa.table({"qb": table["qb"][:1], "found": packed["place"], "wanted": packed["wanted"]})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The `k` highest scores for each row of `queries`: query_id, rank, vec_id, score.

    score is the integer inner product of floor(factor * x) over the components, computed as
    doubles before the floor; ranks from 1, ties to the smaller id; a query's own id is no
    candidate; all candidates are returned if fewer. Ids must be whole numbers. Rows take no
    part if the id or vector is null, a component is null or not finite, or the vector's length
    is not the most common one (of those, the longer); zero vectors take part. Rows that repeat
    id and vector count once; different vectors under one id are rows of their own, and a query
    id with several vectors gets the best of all its pairs. Scores beyond 64 bits count as the
    nearest that fits. Empty tables give empty results. Other columns are not read.

    Every row block meets every query block once a round, in two rounds for scores under 2^20.
    """
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score long"

    def usable(df: DataFrame) -> DataFrame:
        x = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
        return x.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))))

    rows = usable(vectors)
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if sizes is None or not sizes["dim"]:
        return spark.createDataFrame([], out)
    dim, n_rows = sizes["dim"], sizes["count"]

    def blocks(df: DataFrame, n: int, key: str) -> DataFrame:
        dealt = df.where(F.size("v") == dim).distinct().withColumn(key, F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int"))
        return keep(dealt.groupBy(key).applyInArrow(_pack(key, factor), _BLOCK.format(key=key)), f"blocks-{key}")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = min(ROW_BLOCK, max(1024, -(-n_rows // (2 * parts))))
    asked = usable(queries)
    n_asked = asked.count()
    row_blocks, query_blocks = -(-n_rows // block), max(1, -(-n_asked // QUERY_BLOCK))
    left = blocks(rows, row_blocks, "rb")
    right = blocks(asked, query_blocks, "qb").select("qb", *[F.col(c).alias(f"q_{c}") for c in ("n", "ids", "kind", "data", "most")])
    edge = left.agg(F.max("most")).first()[0], right.agg(F.max("q_most")).first()[0]
    if None in edge:
        return spark.createDataFrame([], out)
    bound = min(_LONG, int(edge[0]) * int(edge[1]) * dim)
    small = n_asked * dim * 8 <= BROADCAST_BYTES

    def pairs(state: DataFrame | None):
        """Each row block with each query block and what is known of its queries."""
        q = right.join(state, "qb") if state is not None else right.select("*", F.lit(None).cast("binary").alias("found"), F.lit(None).cast("binary").alias("wanted"))
        met = left.select("*", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb")).repartition("rb", "qb")
        if small:
            return met.join(F.broadcast(q), "qb").groupBy("rb", "qb")
        return met.join(q.select("*", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb")), ["rb", "qb"]).groupBy("rb", "qb")

    # each round tells BITS more of a score's height above the least possible one
    bits = list(range(0, (2 * bound).bit_length(), BITS))[::-1]
    state = found = before = None
    for now in bits:
        counted = pairs(state).applyInArrow(_count(-bound, before, now, k), "qb int, qi int, bin long, n long")
        bins = counted.groupBy("qb", "qi", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("qb", "qi").orderBy(F.desc("bin"))
        placed = bins.withColumn("upto", F.sum("n").over(down)).withColumn("lower", F.lead("bin").over(down))
        if found is None:
            known = placed.withColumn("k", F.lit(k).cast("long")).withColumn("base", F.lit(0).cast("long"))
        else:
            known = placed.join(found.select("qb", "qi", F.col("wanted").alias("k"), F.col("place").alias("base")), ["qb", "qi"])
        # the highest range that reaches the kth, or the lowest there is
        reached = known.where((F.col("upto") - F.col("n") < F.col("k")) & ((F.col("upto") >= F.col("k")) | F.col("lower").isNull()))
        # of the last round the score itself, in decimals as heights may pass 63 bits
        place = F.col("base").cast("decimal(20,0)") * BINS + F.col("bin") - (F.lit(bound).cast("decimal(20,0)") if now == 0 else 0)
        found = keep(reached.select("qb", "qi", place.cast("long").alias("place"), (F.col("k") - F.col("upto") + F.col("n")).alias("wanted")), "places")
        state = keep(found.join(right.select("qb", F.col("q_n").alias("n")), "qb").groupBy("qb").applyInArrow(_state, "qb int, found binary, wanted binary"), "state")
        before = now
    chosen = pairs(state).applyInArrow(_take, "query_id long, vec_id long, score long")
    let_go(spark)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12(embeddings: DataFrame) -> DataFrame:
    """The contract's search: rows whose id is divisible by 50 against all others."""
    return top_k(embeddings, embeddings.where(F.col("vec_id") % 50 == 0))
