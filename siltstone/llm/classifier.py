"""Quality classifier: logistic regression over hashed word n-grams.

Trained with follow-the-regularised-leader updates (per-coordinate rates, L1 and L2), scored
as a sparse dot product. Words are cut into runs of word characters and runs of others, so
that symbols stuck to words count as tokens of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._cluster import crc_mod, mix64
from siltstone.llm._words import per_text, slices, split_words, spread

#: log2 of the number of weights.
BITS = 18
#: Labelled rows that the fit reads at most, chosen by a hash of their id.
FIT_ROWS = 12_000
_PARTS = re.compile(r"\w+|\W+")
_SEED = np.uint64(0x9E3779B97F4A7C15)


def _hash(token: str) -> int:
    """A 64-bit polynomial hash of the code points; the same on every machine."""
    h = len(token)
    for c in token:
        h = (h * 0x100000001B3 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every 1- and 2-gram of all texts, and text boundaries (n + 1)."""
    codes, words, offsets = split_words(texts)
    parts = [[_hash(p) for p in _PARTS.findall(w)] for w in words.to_pylist()]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.fromiter((h for p in parts for h in p), np.uint64, int(size.sum()))
    tokens, ends = spread(codes, np.cumsum(size) - size, size, flat)
    bounds = per_text(ends, offsets)
    n = np.diff(bounds)
    ones = mix64(tokens ^ _SEED)
    twos = mix64(tokens[:-1] * np.uint64(0xD6E8FEB86659FD93) + ones[1:]) if len(tokens) > 1 else ones[:0]
    # a text of n tokens has n ones and n - 1 twos: the place after each one is its two
    out_n = np.maximum(2 * n - 1, 0)
    out_bounds = np.concatenate([[0], np.cumsum(out_n)])
    text = np.repeat(np.arange(len(n)), n)
    place = out_bounds[text] + 2 * (np.arange(len(tokens)) - bounds[text])
    out = np.empty(int(out_bounds[-1]), np.uint64)
    out[place] = ones
    inner = np.arange(len(tokens)) < bounds[text + 1] - 1
    out[place[inner] + 1] = twos[inner[: len(twos)]] if len(twos) else twos
    return (out >> np.uint64(64 - bits)).astype(np.int32), out_bounds


def _chunks(frame: DataFrame, bits: int, score) -> DataFrame:
    """Apply `score(buckets, boundaries)` to the texts of (id, text); adds its double `score`."""
    kind = frame.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                got = score(*features(batch.column("text"), bits))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(got, pa.float64())], ["id", "score"])

    return frame.mapInArrow(run, f"id {kind}, score double")


@dataclass
class Model:
    """Weights of the hashed n-grams and the bias; `bits` is log2 of their number."""

    weights: np.ndarray
    bias: float
    bits: int

    def margins(self, buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Sparse dot product of each text's counts, scaled by one over the root of their sum."""
        n = np.diff(bounds)
        sums = np.concatenate([[0.0], np.cumsum(self.weights[buckets], dtype=np.float64)])
        return self.bias + np.diff(sums[bounds]) / np.sqrt(np.maximum(n, 1))

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """id_col and score (0 to 1) of every row; a null or empty text scores by the bias alone."""
        frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        return _chunks(frame, self.bits, lambda b, o: 1 / (1 + np.exp(-np.clip(self.margins(b, o), -500, 500)))).withColumnRenamed("id", id_col)


def train(rows: list[tuple[np.ndarray, int]], bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.1, l2: float = 0.5, passes: int = 2) -> Model:
    """Follow-the-regularised-leader over (buckets of a text, label), in the given order.

    Each example updates the coordinates it touches: z gathers gradients less the pull of the
    present weights, n their squares; weights are solved for from both when needed. Without
    rows, or with one label alone, the model is (close to) a constant.
    """
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = bias = 0.0

    def solve(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(passes):
        for buckets, label in rows:
            at, counts = np.unique(buckets, return_counts=True)
            x = counts / np.sqrt(max(len(buckets), 1))
            w = solve(z[at], n[at])
            bias = -zb / ((beta + np.sqrt(nb)) / alpha)
            error = 1 / (1 + np.exp(-np.clip(w @ x + bias, -35, 35))) - label
            g = error * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
            zb += error - (np.sqrt(nb + error * error) - np.sqrt(nb)) / alpha * bias
            nb += error * error
    return Model(solve(z, n).astype(np.float32), float(-zb / ((beta + np.sqrt(nb)) / alpha)), bits)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS, bits: int = BITS) -> Model:
    """A model fitted on at most `rows` labelled texts, chosen and ordered by a hash of the id.

    Rows with a null id, text or label, or labels other than 0 and 1, are left out; an id that
    has several labels counts with each. Which rows may be learned from is the caller's choice.
    """
    wanted = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    chosen = wanted.orderBy(F.xxhash64("id"), "id", "label").limit(rows)
    # `rows` bounds what is broadcast: an id and a label each
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "id")
    kind = frame.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                buckets, bounds = features(batch.column("text"), bits)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(buckets))], ["id", "label", "buckets"])

    got = frame.select("id", "label", "text").mapInArrow(run, f"id {kind}, label int, buckets array<int>").toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (hash_order(got.column("id")[i].as_py()), got.column("label")[i].as_py()))
    buckets = got.column("buckets").combine_chunks() if got.num_rows else []
    return train([(np.asarray(buckets[i].values), got.column("label")[i].as_py()) for i in order], bits)


def hash_order(key) -> int:
    """An order of ids without meaning, the same in every run."""
    return _hash(str(key)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: learns from ids whose crc32 mod 5 is not 0, scores all of `documents`."""
    model = fit(docs, labels.where(crc_mod("doc_id", 5) != 0))
    return model.score(docs).select(
        "doc_id",
        F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
