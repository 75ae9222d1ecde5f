"""Stretches of words that repeat with a period, found by minimizers at several scales.

At scale w the text is covered by its grams of w words; of every w / 2 neighbouring grams the
leftmost of least hash is picked. Inside a run of period q, w / 2 < q <= w, picks come again
exactly q words later, so neighbouring picks of equal grams that lie such a distance apart seed
an extension to both sides, word by word. Periods up to SHORT, which no scale covers, are found
by comparing the text with itself at each such lag.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm._cluster import mix64
from siltstone.llm._words import SPACES, WORD_SQL, cut_words, slices
from siltstone.llm.repeats import leftmost_minima

#: A run repeats its period at least so often and has at least so many words.
REPEATS, LEAST_WORDS = 4, 6
#: Periods found by direct lag scans; a power of two, as the scales go on from there.
SHORT = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)

_RUNS = "array<struct<start:long,length:long,period:long>>"
_RUNS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def stretches(values: np.ndarray, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of `least` or more places that equal what is `lag` further."""
    same = np.zeros(max(len(values) - lag, 0) + 2, np.int8)
    same[1:-1] = values[lag:] == values[: max(len(values) - lag, 0)]
    turns = np.flatnonzero(same[1:] != same[:-1])
    starts, ends = turns[::2], turns[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def _first_difference(values: np.ndarray, i: int, lag: int, step: int) -> int:
    """The first place from i on, going by `step` (1 or -1), that differs from what is `lag` further."""
    size = 64
    while True:
        if step > 0:
            stop = min(i + size, len(values) - lag)
            differs = np.flatnonzero(values[i:stop] != values[i + lag : stop + lag])
            if len(differs):
                return i + int(differs[0])
            if stop == len(values) - lag:
                return stop
            i = stop
        else:
            stop = max(i - size, -1)
            differs = np.flatnonzero(values[stop + 1 : i + 1] != values[stop + 1 + lag : i + 1 + lag])
            if len(differs):
                return stop + 1 + int(differs[-1])
            if stop == -1:
                return -1
            i = stop
        size *= 2


def seeds(values: np.ndarray, owner: np.ndarray, sizes: np.ndarray, most_period: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, lag) of neighbouring picks of equal grams, for the lags of each scale.

    `owner` numbers the text of each place and `sizes` has the words of each text: texts too
    short for a scale's periods leave it. Texts are parted by values that occur once.
    """
    at, gram, width = np.arange(len(values)), mix64(values.view(np.uint64)), 1
    while width < 2 * most_period:
        if width > SHORT:
            picked = leftmost_minima(gram[: len(gram) - width + 1], width // 2)
            picked = picked[np.flatnonzero(np.diff(picked, prepend=-1))]
            order = np.argsort(gram[picked], kind="stable")
            keys, places = gram[picked][order], at[picked][order]
            lags = np.diff(places)
            fits = (keys[1:] == keys[:-1]) & (lags > width // 2) & (lags <= width)
            yield places[:-1][fits], lags[fits]
        # grams of twice the width; near the end of all texts they wrap, into places no gram starts at
        gram = mix64(gram * _ODD + np.roll(gram, -width))
        width *= 2
        fit = sizes[owner[at]] >= REPEATS * (width // 2 + 1)
        at, gram = at[fit], gram[fit]
        if len(at) < 2 * width:
            return


def find_runs(codes: np.ndarray, bounds: np.ndarray, repeats: int = REPEATS, least_words: int = LEAST_WORDS) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period.

    `codes` number the words of all texts, `bounds` (texts + 1) say where each begins. `repeats`
    must be REPEATS or more, which the scales are made for.
    """
    sizes = np.diff(bounds)
    texts = np.arange(len(sizes))
    owner = np.repeat(texts, sizes + 1)  # each text ends with a value of its own
    values = np.empty(len(codes) + len(sizes), np.int64)
    begins = bounds[:-1] + texts
    inside = np.ones(len(values), bool)
    inside[begins + sizes] = False
    values[inside], values[~inside] = codes, -1 - texts
    most = int(sizes.max(initial=0)) // repeats
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lag in range(1, min(SHORT, most) + 1):
        starts, ends = stretches(values, lag, max(least_words, repeats * lag) - lag)
        found.append((starts, ends + lag, np.full(len(starts), lag)))
    if most > SHORT:
        for places, lags in seeds(values, owner, sizes, most):
            order = np.lexsort((places, lags))
            hits, lag_before, end_before = [], 0, 0
            for place, lag in zip(places[order].tolist(), lags[order].tolist(), strict=True):
                if lag == lag_before and place < end_before:
                    continue
                end = _first_difference(values, place, lag, 1)
                lag_before, end_before = lag, end
                start = _first_difference(values, place, lag, -1) + 1
                if end - start >= max(least_words, repeats * lag) - lag:
                    hits.append((start, end + lag, lag))
            if hits:
                found.append(tuple(np.array(hits, np.int64).T))
    if not found:
        return np.zeros((0, 4), np.int64)
    start, end, period = (np.concatenate([f[i] for f in found]).astype(np.int64) for i in range(3))
    # the same stretch under several periods: the smallest divides the others
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    text = owner[start] if len(start) else start
    rows = np.stack([text, start - begins[text], end - start, period], 1)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def collapse(codes: np.ndarray, bounds: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and bounds without the words that any run has after its first period."""
    change = np.zeros(len(codes) + 1, np.int64)
    first = bounds[runs[:, 0]] + runs[:, 1]
    np.add.at(change, first + runs[:, 3], 1)
    np.add.at(change, first + runs[:, 2], -1)
    kept = np.cumsum(change[:-1]) == 0
    upto = np.concatenate([[0], np.cumsum(kept)])
    return codes[kept], upto[bounds]


def _scan(repeats: int, least_words: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                codes, vocabulary, bounds, _ = cut_words(batch.column("text"), SPACES)
                runs = find_runs(codes, bounds, repeats, least_words)
                offsets = np.searchsorted(runs[:, 0], np.arange(batch.num_rows + 1)).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in (1, 2, 3)], ["start", "length", "period"]))
                kept, upto = collapse(codes, bounds, runs)
                collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), vocabulary.take(pa.array(kept))), " ")
                yield pa.RecordBatch.from_arrays([batch.column("id"), listed.cast(_RUNS_ARROW), collapsed], ["id", "runs", "collapsed"])

    return scan


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: int = REPEATS, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per input row: `id_col`, `runs` and `collapsed`.

    Words are what spaces and U+0009 to U+000D part. A run is a stretch of words with smallest
    period q, of max(least_words, repeats * q) words or more, that no neighbouring word extends
    with that period; `runs` lists start (word number from 0), length and period by start, then
    period. `collapsed` joins by one space the words that no run has after its first q words.
    `repeats` is 4 at least. Grams are compared by 64-bit hashes to find seeds; every run is
    verified word by word.

    Each row is judged by itself: a null or empty text has no runs and collapses to the empty
    text, repeated rows and null ids are rows like others, an empty table gives an empty one.
    A whole text, however long, is searched in memory that grows with its length. Other
    columns are not read, so their names can not clash.
    """
    if repeats < REPEATS:
        raise ValueError(f"repeats must be {REPEATS} or more")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_scan(repeats, least_words), f"id {rows.schema['id'].dataType.simpleString()}, runs {_RUNS}, collapsed string")
    return found.withColumnRenamed("id", id_col)


def planted(id_col: Column, text: Column) -> Column:
    """The contract's texts: of ids whose crc32 ends in 0, words from a on repeat p of them."""
    h = F.crc32(id_col.cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(text, F.lit(WORD_SQL), F.lit(0))

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))
        return F.array_join(F.transform(at, lambda i: F.get(w, i)), " ")

    # a one-element array names the words, so that they are found once
    changed = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(text)), F.lit(0))
    return F.when(F.pmod(h, F.lit(10)) == 0, changed).otherwise(text)


def op11(docs: DataFrame) -> DataFrame:
    """The contract's digest of periodic_runs over `documents` with repeats planted."""
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("fewer"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("longest.before"), F.col("longest.length"), -F.col("longest.fewer")
    return best.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * longest.length div -longest.fewer").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
