"""Best-fit packing of tokenised documents with large-item matching.

Lengths are at most the capacity, so the corpus is summed up by a histogram of as many
numbers as the capacity has. The packing is decided on that histogram: lengths above a third
of the capacity are matched greedily, two to a bin at most; smaller ones fill the tightest
gaps. The decision is a list of segments (rank range of a length -> bins and offsets), and
each document finds its place from its rank among the documents of its length.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm._cluster import keep, n_buckets, ranked
from siltstone.llm._pieces import public_path, word_bpe
from siltstone.llm._words import per_text, slices, split_words, spread

#: Tokens in a sequence, and the id that ends a document.
CAPACITY, END_ID = 2048, 0
VOCABULARY = "word_bpe_49k.json"


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most `capacity` ids: id_col, piece, start, length, ids.

    `ids` is binary, each id as a little-endian unsigned 32-bit number; unpack_ids() lists them.
    A document's ids end with `end_id`; only documents longer than `capacity` are cut. A null
    or empty text is the end id alone; repeated rows give their pieces again; a null id stays
    null. `vocabulary` is a tokenizer file on the workers (default: the public word BPE).
    """
    path = vocabulary or public_path(VOCABULARY)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_bpe(path)
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                codes, words, offsets = split_words(batch.column("text"))
                ids, ends = spread(codes, *memo.runs(words))
                bounds = per_text(ends, offsets)
                n = np.diff(bounds) + 1
                # the documents' ids one after the other, each with its end id
                flat = np.full(int(n.sum()), end_id, "<u4")
                first = np.cumsum(n) - n
                flat[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n - 1)] = ids
                count = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(n[row] - start, capacity)
                cuts = pa.array((np.append(first[row] + start, len(flat)) * 4).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, cuts.buffers()[1], pa.py_buffer(flat)])],
                    ["id", "piece", "start", "length", "ids"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(pieces, f"id {kind}, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Segments (length, first rank, end rank, items per bin, first bin, offset) for a histogram.

    Items first..end of a length go to consecutive bins from `first bin`, `per bin` of them in
    each, the first at `offset`. There are a few segments per length at most, whatever the
    counts. Lengths over the capacity or under 1 are refused.
    """
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    segments: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of bins (first, count)
    bins = 0

    def take(length: int, n: int, per: int, first_bin: int) -> None:
        offset = capacity - room
        segments.append((length, used[length], used[length] + n, per, first_bin, offset))
        used[length] += n
        left[length] -= n

    def leave(gap: int, first: int, count: int) -> None:
        if gap and count:
            gaps.setdefault(gap, []).append((first, count))

    # Large items, longest first: each with the longest other large one that still fits.
    large = sorted(n for n in left if 3 * n > capacity)
    for length in reversed(large):
        while left[length]:
            top = bisect.bisect_right(large, capacity - length) - 1
            while top >= 0 and (left[large[top]] == 0 or (large[top] == length and left[length] < 2)):
                top -= 1
            room = capacity
            if top < 0:
                n = left[length]
                take(length, n, 1, bins)
                leave(capacity - length, bins, n)
            elif (other := large[top]) == length:
                n = left[length] // 2
                take(length, 2 * n, 2, bins)
                leave(capacity - 2 * length, bins, n)
            else:
                n = min(left[length], left[other])
                take(length, n, 1, bins)
                room = capacity - length
                take(other, n, 1, bins)
                leave(room - other, bins, n)
            bins += n
    # Small items, longest first: into the tightest gap, which then takes as many as it can.
    tight = sorted(gaps)
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            i = bisect.bisect_left(tight, length)
            if i < len(tight):
                room = tight[i]
                first, count = gaps[room].pop()
                if not gaps[room]:
                    del gaps[room], tight[i]
            else:
                room, first = capacity, bins
                count = -(-left[length] // (capacity // length))
                bins += count
            per = room // length
            full = min(count, left[length] // per)
            if full:
                take(length, full * per, per, first)
            rest = [(room - per * length, first, full)]
            first, count = first + full, count - full
            if count and (some := left[length]):  # fewer than fit one bin
                take(length, some, some, first)
                rest.append((room - some * length, first, 1))
                first, count = first + 1, count - 1
            for gap, a, n in [*rest, (room, first, count)]:
                if gap and n:
                    if gap not in gaps:
                        bisect.insort(tight, gap)
                    leave(gap, a, n)
    return np.array(segments, dtype=np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, order: tuple[str, ...] = ("doc_id", "piece"), length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """`pieces` with sequence_id and offset: sequences of at most `capacity`, filled without gaps.

    The input is written to the shared folder once, as it is read for the histogram and again
    for the placing; the histogram (at most `capacity` rows) is all that reaches the driver.
    `order` should tell rows apart; equal rows take their places in any order. An empty table
    gives an empty result. Columns named sequence_id or offset are replaced.
    """
    rows = keep(pieces.drop("sequence_id", "offset"), "pieces")
    counts = {int(r[0]): int(r[1]) for r in rows.groupBy(F.col(length_col)).count().collect()}
    segments = plan(counts, capacity)
    segments = segments[np.lexsort((segments[:, 1], segments[:, 0]))]
    step = np.int64(1) << np.int64(50)
    keys = segments[:, 0] * step + segments[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        s = segments[np.searchsorted(keys, n * step + r, side="right") - 1]
        nth = r - s[:, 1]
        return pd.DataFrame({"sequence_id": s[:, 4] + nth // s[:, 3], "offset": s[:, 5] + nth % s[:, 3] * n})

    numbered = ranked(rows, [length_col], list(order), n_buckets(rows.sparkSession), "__rank")
    placed = numbered.withColumn("__place", place(F.col(length_col), F.col("__rank")))
    return placed.select(*rows.columns, "__place.sequence_id", "__place.offset")


@F.pandas_udf(T.ArrayType(T.LongType()))
def unpack_ids(ids: pd.Series) -> pd.Series:
    """The ids of a binary column as a list."""
    return ids.map(lambda x: None if x is None else np.frombuffer(x, "<u4").astype(np.int64))


def op2(docs: DataFrame) -> DataFrame:
    """The contract's digest of the packing of `documents`: ids travel as their crc32."""
    pieces = tokenize(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
