"""Large JSON arrays, read by byte ranges in parallel.

A range does not know whether it starts inside a string, nor how deep. So each range first tells
how many quotes it has and what it adds to the depth either way; sums over the ranges before
it then say where it starts, and each range returns the elements that begin in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a range, and of what is read at a time behind its end to finish its last element.
RANGE, FURTHER = 16 << 20, 1 << 20
_BACKSLASH, _QUOTE, _COMMA, _OPEN, _CLOSE = (ord(c) for c in '\\",[]')
_STEP = np.zeros(256, np.int64)
_STEP[[ord("["), ord("{")]], _STEP[[ord("]"), ord("}")]] = 1, -1


class _File:
    """Bytes of a file of any file system that Arrow knows."""

    def __init__(self, path: str):
        system, name = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)
        self.size = self.file.size()

    def read(self, start: int, stop: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(max(0, min(stop, self.size) - start), start), np.uint8)

    def escaped(self, at: int) -> bool:
        """Whether the byte there has an odd number of backslashes before it."""
        n = 0
        while at - n > 0:
            block = self.read(max(0, at - n - 4096), at - n)[::-1]
            others = np.flatnonzero(block != _BACKSLASH)
            n += int(others[0]) if len(others) else len(block)
            if len(others):
                break
        return n % 2 == 1


def quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Where quotes open or close strings: those that no backslash escapes."""
    slash = data == _BACKSLASH
    run = np.arange(len(data)) - np.maximum.accumulate(np.where(~slash, np.arange(len(data)), -1))
    if escaped and len(data):
        run[: int(np.argmin(slash)) if not slash.all() else len(data)] += 1
    before = np.concatenate([[int(escaped)], run[:-1]])
    return np.flatnonzero((data == _QUOTE) & (before % 2 == 0))


def _outside(data: np.ndarray, escaped: bool, in_string: bool) -> np.ndarray:
    """Which bytes lie outside of strings."""
    turns = np.zeros(len(data), np.int64)
    turns[quotes(data, escaped)] = 1
    return (np.cumsum(turns) + in_string) % 2 == 0


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop")), strict=True):
            file = _File(path)
            data, escaped = file.read(start, stop), file.escaped(start)
            steps = _STEP[data]
            free = _outside(data, escaped, False)
            yield pa.RecordBatch.from_pydict({"path": [path], "start": [start], "stop": [stop], "odd": [int(len(quotes(data, escaped)) % 2)], "outside": [int(steps[free].sum())], "inside": [int(steps[~free].sum())], "array": [start == 0 and data.tobytes().lstrip()[:1] == b"["]})


def elements(file: _File, start: int, stop: int, in_string: bool, depth: int) -> Iterator[bytes]:
    """The elements of the outer array whose separator (the opening bracket or a comma) lies in the range."""
    held, at, open_ = b"", start, False
    while at < file.size:
        data = file.read(at, stop if at < stop else at + FURTHER)
        free = _outside(data, file.escaped(at), in_string)
        level = depth + np.cumsum(np.where(free, _STEP[data], 0))
        is_mark = free & (((data == _COMMA) & (level == 1)) | ((data == _OPEN) & (level == 1)) | ((data == _CLOSE) & (level == 0)))
        begin = 0
        for mark in np.flatnonzero(is_mark).tolist():
            if open_:
                yield held + data[begin:mark].tobytes()
            held, begin = b"", mark + 1
            # what a mark behind the range begins is another range's
            open_ = at + mark < stop and data[mark] != _CLOSE
            if at + mark >= stop:
                return
        if open_:
            held += data[begin:].tobytes()
        elif at >= stop or at + len(data) >= stop:
            return
        if len(data):
            in_string, depth = not free[-1], int(level[-1])
        at += len(data)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start, stop, in_string, depth in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop", "in_string", "depth")), strict=True):
            found: list[bytes] = []
            for element in elements(_File(path), start, stop, bool(in_string), depth):
                if element.strip():
                    found.append(element.strip())
                if len(found) >= 1000:
                    yield pa.RecordBatch.from_pydict({"raw": pa.array(found, pa.binary())})
                    found = []
            yield pa.RecordBatch.from_pydict({"raw": pa.array(found, pa.binary())})


def read_json_arrays(spark: SparkSession, path: str, suffix: str = ".json", size: int = RANGE) -> DataFrame:
    """(raw): the text of every element of the JSON arrays in the files of that suffix, in UTF-8.

    A task holds one range of `size` bytes and the element that it ends in. A file that does not
    start with an array gives no rows. Files are opened by Arrow, on file systems that it knows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("path").endswith(suffix))
    sized = files.select("path", "length").where("length > 0")
    ranges = sized.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + size, "length").alias("stop"))
    n = max(1, ranges.count())
    marks = ranges.repartition(n, "path", "start").mapInArrow(_marks, "path string, start long, stop long, odd long, outside long, inside long, array boolean")
    # a few numbers a range: in strings by the quotes before, then the depth
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = marks.withColumn("in_string", F.pmod(F.coalesce(F.sum("odd").over(before), F.lit(0)), F.lit(2)))
    # the sums were made as if outside: inside a string the two change places
    step = F.when(F.col("in_string") == 0, F.col("outside")).otherwise(F.col("inside"))
    placed = known.withColumn("step", step).withColumn("depth", F.coalesce(F.sum("step").over(before), F.lit(0)))
    arrays = placed.withColumn("array", F.max("array").over(Window.partitionBy("path"))).where("array")
    read = arrays.select("path", "start", "stop", "in_string", "depth").repartition(n, "path", "start")
    return read.mapInArrow(_read, "raw binary").select(F.col("raw").cast("string").alias("raw"))
