"""Suffix-array deduplication of repeated byte passages.

Every window of LENGTH bytes has an anchor, its least hashed gram, which depends on its bytes
alone; equal windows have equal anchors. Windows of a text with one anchor form a run. Runs are
sorted over range partitions by anchor and content: of equal runs all but the first are
repeats as they stand. Runs that share the anchor but not the content are compared byte by
byte: their suffixes are sorted in two stages (directly those smaller than their successors,
the rest induced by bucket scans) and windows with a common prefix of LENGTH are found next
to each other. Only those runs leave their texts. Runs of an anchor that very many share are
sorted in bounded groups first; what no group repeats goes on under a further anchor.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm._cluster import keep, mix64
from siltstone.llm._words import slices

LENGTH, GRAM = 100, 24
#: Runs whose suffixes are sorted in one group, about. Anchors of more than MOST_RUNS runs are first
#: thinned in groups of that size and parted by further anchors, up to ROUNDS times.
GROUP_RUNS, MOST_RUNS, ROUNDS = 4000, 20_000, 8
#: Parts two runs; no byte of UTF-8.
SEPARATOR = 0xFF
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM (24) bytes from every place of `data`."""
    packed = data.astype(np.uint64)
    for width in (1, 2, 4):
        packed = packed[:-width] | packed[width:] << np.uint64(8 * width)
    n = len(data) - GRAM + 1
    return mix64(packed[:n] * _C[0] + packed[8 : 8 + n] * _C[1] + packed[16 : 16 + n] * _C[2])


def leftmost_minima(values: np.ndarray, window: int) -> np.ndarray:
    """Place of the least value (the first of equal ones) in every window of `window` values."""
    low, at, size = values, np.arange(len(values), dtype=np.int32), 1
    while size < window:
        step = min(size, window - size)
        n = len(low) - step
        right = low[step:] < low[:n]
        at = np.where(right, at[step:], at[:n])
        low = np.where(right, low[step:], low[:n])
        size += step
    return at


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, seed: int = 0):
    """For texts in `data`: runs of windows with one anchor: (text, start, count, gram, whole).

    The anchor of a window of `length` bytes is its least gram, in an order of its own for each
    seed. `whole` hashes all bytes that the run's windows cover.
    """
    size = np.diff(bounds)
    long = np.flatnonzero(size >= length)
    if not len(long):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams = gram_hashes(data)
    if seed:
        grams = mix64(grams + np.uint64(seed) * _C[0])
    at = leftmost_minima(grams, length - GRAM + 1)
    count = size[long] - length + 1
    starts = np.repeat(bounds[long] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    text = np.repeat(long, count)
    a = at[starts]
    fresh = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (text[1:] != text[:-1])))
    n = np.diff(np.append(fresh, len(a)))
    first = starts[fresh]
    last_gram = first + n - 1 + length - GRAM
    whole = n.astype(np.uint64)
    for j in range(0, 2 * length, GRAM):
        whole = mix64(whole * _C[0] + grams[np.minimum(first + j, last_gram)])
    return text[fresh], first - bounds[text[fresh]], n, grams[a[fresh]], whole


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array one after the other, and boundaries (n + 1)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    x = pc.fill_null(texts.cast(pa.large_binary()), b"")
    bounds = np.frombuffer(x.buffers()[1], np.int64, len(x) + 1, x.offset * 8)
    if x.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(x) + 1, np.int64)
    return np.frombuffer(x.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def _words8(text: np.ndarray, length: int) -> np.ndarray:
    """Big-endian 8-byte words from every place, zeros beyond the end."""
    packed = np.concatenate([text, np.zeros(length + 16, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        packed = packed[:-width] << np.uint64(8 * width) | packed[width:]
    return packed


def _direct(places: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """`places` sorted by the `length` bytes from each (a little more at most); equal ones in any order."""
    order = places[np.argsort(words[places], kind="stable")]
    group = np.cumsum(np.append(True, words[order][1:] != words[order][:-1]))
    for depth in range(8, length, 8):
        tied = np.append(False, group[1:] == group[:-1])
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        w, g = words[order[at] + depth], group[at]
        by = np.lexsort((w, g))
        order[at] = order[at][by]
        w = w[by]
        # a new group begins where the old one did or the word changes
        begins = np.append(True, group[1:] != group[:-1])
        begins[at[1:]] |= (w[1:] != w[:-1]) & (g[1:] == g[:-1])
        group = np.cumsum(begins)
    return order


def suffix_array(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Places of `text` (uint8) ordered by the `length` bytes from each, by two-stage sorting.

    Type B suffixes are smaller than their successors and sorted directly. A type A suffix
    follows its successor in the order, so a scan over the buckets of first bytes from the
    least one finds each after its successor: within a bucket they stand before type B, in the
    order of their successors. Suffixes equal over `length` bytes may stand in any order.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    # type by the next byte that differs; the end counts as less than any byte
    change = np.flatnonzero(text[1:] != text[:-1])
    run_end = np.append(change, n - 1)
    rises = np.append(text[change] < text[change + 1], False)
    type_a = ~np.repeat(rises, np.diff(np.append(-1, run_end)))
    b_sorted = _direct(np.flatnonzero(~type_a), _words8(text, length), length)
    b_start = np.searchsorted(text[b_sorted], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))  # after the empty suffix
    out = []

    def scan(bucket: np.ndarray, byte: int) -> np.ndarray:
        """Queue the type A predecessors of sorted suffixes; returns those of the same bucket."""
        before = bucket[bucket > 0] - 1
        before = before[type_a[before]]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        kinds, starts = np.unique(first, return_index=True)
        here = before[:0]
        for kind, part in zip(kinds.tolist(), np.split(before, starts[1:]), strict=True) if len(kinds) else []:
            if kind == byte:
                here = part
            else:
                waiting[kind].append(part)
        return here

    for byte in range(256):
        wave = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        while len(wave):  # runs of one byte: each round goes one byte further to the left
            out.append(wave)
            wave = scan(wave, byte)
        direct = b_sorted[b_start[byte] : b_start[byte + 1]]
        if len(direct):
            out.append(direct)
            scan(direct, byte)  # a type A suffix before a type B one starts with a larger byte
    return np.concatenate(out)


def later_windows(text: np.ndarray, starts: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows at `starts` equal one of smaller `order`: by adjacent common prefixes."""
    if not len(starts):
        return np.zeros(0, bool)
    number = np.full(len(text), -1, np.int64)
    number[starts] = np.arange(len(starts))
    sa = suffix_array(text, length)
    ranked = number[sa]
    ranked = ranked[ranked >= 0]
    words, at = _words8(text, length), starts[ranked]
    same = np.ones(max(len(at) - 1, 0), bool)
    for depth in [*range(0, length - 7, 8), length - 8]:
        w = words[at + depth]
        same &= w[1:] == w[:-1]
    cluster = np.cumsum(np.append(True, ~same)) - 1
    least = np.full(int(cluster[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, cluster, order[ranked])
    later = np.zeros(len(starts), bool)
    later[ranked] = order[ranked] > least[cluster]
    return later


def window_runs(docs: DataFrame, length: int) -> DataFrame:
    """(gram, whole, id, th, run) of (id, th, text): run is start << 16 | number of windows."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text, start, n, gram, whole = anchors(*utf8(part.column("text")), length)
                row = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64)), part.column("id").take(row), part.column("th").take(row), pa.array(start << 16 | n)],
                    ["gram", "whole", "id", "th", "run"],
                )

    return docs.mapInArrow(run, f"gram long, whole long, id {kind}, th long, run long")


def _differs(*columns: pa.ChunkedArray) -> np.ndarray:
    """Where a row differs from the row before in any column, the first row included."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        a = np.asarray(c.combine_chunks().dictionary_encode(null_encoding="encode").indices) if not pa.types.is_int64(c.type) or c.null_count else np.asarray(c)
        out[1:] |= a[1:] != a[:-1]
    return out


def _each_after_another(batches: Iterator[pa.RecordBatch], same: Sequence[str], *keys: Sequence[str]) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
    """Batches of a sorted partition without rows that equal the row before in the columns `same`,
    and where each row begins a new value of each of `keys`; the last row is carried on."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        joined = table if before is None else pa.concat_tables([before, table])
        skip = int(before is not None)
        new = [_differs(*(joined[c] for c in columns))[skip:] for columns in (same, *keys)]
        before = table.slice(table.num_rows - 1)
        keep_rows = np.flatnonzero(new[0])
        if len(keep_rows):
            yield table.take(pa.array(keep_rows)), [k[keep_rows] for k in new[1:]]


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted range partition: repeats (equal runs after the first) and runs to compare.

    To compare: first runs of an anchor that has several, and all first runs of the anchors
    at the partition's borders, which may go on in the next partition. A task holds a batch and
    the one first run of which it is not known yet whether its anchor has others.
    """
    waiting = first = None

    def out(table: pa.Table, again: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from table.select(["gram", "id", "th", "run"]).append_column("again", pa.array(again)).combine_chunks().to_batches()

    for table, (head, fresh) in _each_after_another(batches, ("gram", "whole", "id", "th", "run"), ("gram", "whole"), ("gram",)):
        gram = np.asarray(table["gram"])
        first = gram[0] if first is None else first
        group = np.cumsum(fresh)  # 0: rows of the anchor that the batch before ended with
        heads = np.bincount(group, weights=head, minlength=group[-1] + 1)
        known = heads > 1
        known[0] |= heads[0] > 0  # that anchor had one at least
        if waiting is not None:
            if heads[0]:
                yield from out(waiting, np.array([False]))
                waiting = None
            elif group[-1]:
                waiting = None  # its anchor is over, and it was alone
        open_head = head & (group == group[-1]) & ~known[group] & (gram != first)
        if open_head.any():
            waiting = table.slice(int(np.flatnonzero(open_head)[0]), 1)
        chosen = ~head | known[group] | (gram == first)
        if chosen.any():
            yield from out(table.filter(pa.array(chosen)), ~head[chosen])
    if waiting is not None:
        yield from out(waiting, np.array([False]))


def _order_of(table: pa.Table) -> np.ndarray:
    """Rank of each row by id (null last), th and run."""
    by = pc.sort_indices(table, sort_keys=[("id", "ascending"), ("th", "ascending"), ("run", "ascending")], null_placement="at_end")
    rank = np.empty(table.num_rows, np.int64)
    rank[np.asarray(by)] = np.arange(table.num_rows)
    return rank


def _intervals(row: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte intervals of windows (row, start), which are sorted: neighbours become one interval."""
    fresh = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1))) if len(row) else row
    last = np.append(fresh[1:], len(row)) - 1 if len(row) else row
    return row[fresh], start[fresh], start[last] + length


def repeated_intervals(docs: DataFrame, length: int = LENGTH, most_runs: int = MOST_RUNS) -> DataFrame:
    """(id, th, start, end) of (id, th, text): bytes in windows that occur earlier, in pieces."""
    spark = docs.sparkSession
    kind = docs.schema["id"].dataType.simpleString()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = window_runs(docs, length)
    order = [F.col("gram"), F.col("whole"), F.col("id").asc_nulls_last(), F.col("th"), F.col("run")]
    found = keep(runs.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_verdicts, f"gram long, id {kind}, th long, run long, again boolean"), "runs")
    start, count = F.shiftright("run", 16), F.col("run").bitwiseAND(F.lit(0xFFFF))
    again = found.where("again").select("id", "th", start.alias("start"), (start + count - 1 + length).alias("end"))
    heads = found.where(~F.col("again"))
    # anchors with more runs than one group may hold
    busy = heads.groupBy("gram").agg(F.count(F.lit(1)).alias("n_runs")).where(F.col("n_runs") > most_runs).withColumnRenamed("gram", "busy")
    marked = heads.join(busy, F.col("gram") == F.col("busy"), "left").select("id", "th", F.struct("gram", "run", F.col("busy").isNotNull().alias("busy")).alias("run"))
    wanted = marked.groupBy("id", "th").agg(F.collect_list("run").alias("runs")).select(F.col("id").alias("of"), F.col("th").alias("text_hash"), "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, bounds = utf8(batch.column("text"))
                runs_of = batch.column("runs")
                parts = runs_of.flatten()
                row = np.repeat(np.arange(batch.num_rows), np.asarray(runs_of.value_lengths()))
                run = np.asarray(parts.field("run"))
                first = bounds[row] + (run >> 16)
                size = (run & 0xFFFF) - 1 + length
                text = data[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
                cuts = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [parts.field("gram"), batch.column("id").take(take), batch.column("th").take(take), parts.field("run"), parts.field("busy"), pa.BinaryArray.from_buffers(pa.binary(), len(run), [None, cuts.buffers()[1], pa.py_buffer(text)])],
                    ["gram", "id", "th", "run", "busy", "bytes"],
                )

    texts = docs.join(wanted, F.col("id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("text_hash"))).select("id", "th", "text", "runs")
    pieces = keep(texts.mapInArrow(cut, f"gram long, id {kind}, th long, run long, busy boolean, bytes binary"), "pieces")
    groups = max(1, -(-pieces.count() // GROUP_RUNS))
    schema = f"id {kind}, th long, start long, end long"

    def compare(table: pa.Table) -> pa.Table:
        return _removed(*_sorted_windows(table, length)[:5], length)

    def in_groups(part: DataFrame) -> DataFrame:
        """Runs under one anchor in one group, several anchors in each."""
        return part.withColumn("group", F.pmod(F.xxhash64("gram"), F.lit(groups))).groupBy("group").applyInArrow(compare, schema)

    out = again.unionByName(in_groups(pieces.where(~F.col("busy"))))
    crowded = pieces.where("busy").drop("busy")
    thinned_schema = f"gram long, id {kind}, th long, run long, bytes binary, start long, end long"
    for seed in range(1, ROUNDS + 1):
        n_runs = crowded.count()
        if not n_runs:
            break
        dealt = crowded.withColumn("group", F.pmod(F.xxhash64("id", "th", "run"), F.lit(-(-n_runs // GROUP_RUNS))))
        thinned = keep(dealt.groupBy("group").applyInArrow(_thin(seed, length), thinned_schema), "thinned")
        out = out.unionByName(thinned.where(F.col("bytes").isNull()).select("id", "th", "start", "end"))
        rest = thinned.where(F.col("bytes").isNotNull()).select("gram", "id", "th", "run", "bytes")
        busy = rest.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > (most_runs if seed < ROUNDS else 2**62)).select("gram")
        out = out.unionByName(in_groups(rest.join(busy, "gram", "left_anti")))
        crowded = rest.join(busy, "gram", "left_semi")
    return out


def _sorted_windows(table: pa.Table, length: int) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of runs (id, th, run, bytes, ..): the different ones in order, their run numbers, and for each
    window its row, its place there, and whether it equals an earlier one; then all bytes and their borders."""
    table = table.sort_by([("run", "ascending")])
    rank = _order_of(table)
    table = table.take(pa.array(np.argsort(rank)))
    table = table.filter(pa.array(_differs(table["id"], table["th"], table["run"])))
    run = np.asarray(table["run"])
    data, bounds = utf8(table["bytes"].combine_chunks())
    # each run is followed by a separator
    text = np.full(len(data) + len(run), SEPARATOR, np.uint8)
    text[np.arange(len(data)) + np.repeat(np.arange(len(run)), np.diff(bounds))] = data
    windows = run & 0xFFFF
    row = np.repeat(np.arange(len(run)), windows)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    later = later_windows(text, (bounds[:-1] + np.arange(len(run)))[row] + offset, np.arange(len(row)), length)
    return table, run, row, offset, later, data, bounds


def _removed(table: pa.Table, run: np.ndarray, row: np.ndarray, offset: np.ndarray, later: np.ndarray, length: int) -> pa.Table:
    """(id, th, start, end) of the windows that equal earlier ones."""
    r, a, b = _intervals(row[later], (run >> 16)[row[later]] + offset[later], length)
    some = table.take(pa.array(r))
    return pa.table({"id": some["id"], "th": some["th"], "start": pa.array(a, pa.int64()), "end": pa.array(b, pa.int64())})


def _thin(seed: int, length: int):
    """Of a group of runs: what equals an earlier window there, and the other windows as shorter runs.

    A shorter run is of windows that share one more anchor, by another order of grams; equal
    windows share it too, so they still meet, at most one of each from a group.
    """

    def thin(table: pa.Table) -> pa.Table:
        table, run, row, offset, later, data, bounds = _sorted_windows(table, length)
        gone = _removed(table, run, row, offset, later, length)
        _, _, n, gram, _ = anchors(data, bounds, length, seed)
        of = np.repeat(np.arange(len(n)), n)  # the windows of all runs in order, as above
        stay = np.flatnonzero(~later)
        fresh = np.append(True, (stay[1:] != stay[:-1] + 1) | (of[stay][1:] != of[stay][:-1])) if len(stay) else np.zeros(0, bool)
        head, count = stay[fresh], np.diff(np.append(np.flatnonzero(fresh), len(stay)))
        first, size = bounds[row[head]] + offset[head], count - 1 + length
        text = data[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        cuts = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        some = table.take(pa.array(row[head]))
        both = mix64(np.asarray(some["gram"]).view(np.uint64) * _C[1] + gram[of[head]])
        left = pa.table({
            "gram": both.view(np.int64), "id": some["id"], "th": some["th"], "run": ((run >> 16)[row[head]] + offset[head]) << 16 | count,
            "bytes": pa.BinaryArray.from_buffers(pa.binary(), len(head), [None, cuts.buffers()[1], pa.py_buffer(text)]),
            "start": pa.nulls(len(head), pa.int64()), "end": pa.nulls(len(head), pa.int64()),
        })
        none = lambda t: pa.nulls(gone.num_rows, t)
        return pa.concat_tables([left, pa.table({"gram": none(pa.int64()), "id": gone["id"], "th": gone["th"], "run": none(pa.int64()), "bytes": none(pa.binary()), "start": gone["start"], "end": gone["end"]})])

    return thin


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, most_runs: int = MOST_RUNS) -> DataFrame:
    """One row per input row: id_col, n_bytes, spans (removed, as [start, end) bytes) and kept (binary).

    Removed is each byte of a text (as UTF-8) in a string of `length` bytes that also starts
    earlier: in a row of smaller id, or of the same id and smaller text hash, or earlier in the
    same text; a null id comes last. Strings lie within a text and are judged on the input.
    Rows that repeat both id and text are one document and get the same result. Null texts are
    empty; texts under `length` bytes lose nothing; an empty table gives an empty result. Other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = repeated_intervals(rows, length, most_runs)
    listed = found.groupBy("id", "th").agg(F.collect_list(F.struct("start", "end")).alias("found")).select(F.col("id").alias("of"), F.col("th").alias("text_hash"), "found")
    joined = rows.join(listed, F.col("id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("text_hash")), "left").select("id", "text", "found")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for batch in slices(whole, "text"):
                data, bounds = utf8(batch.column("text"))
                found = batch.column("found")
                parts = found.flatten()
                row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.fill_null(found.value_lengths(), 0)))
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, bounds[row] + np.asarray(parts.field("start")), 1)
                np.add.at(edge, bounds[row] + np.asarray(parts.field("end")), -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans, kept = [], []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    g = gone[a:b]
                    flips = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
                    spans.append([{"start": s, "end": e} for s, e in flips.reshape(-1, 2).tolist()])
                    kept.append(data[a:b][~g].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(bounds)), pa.array(spans, span), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(remove, f"id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary").withColumnRenamed("id", id_col)


def op9(docs: DataFrame) -> DataFrame:
    """The contract's digest of drop_repeats over `documents`."""
    return drop_repeats(docs).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
