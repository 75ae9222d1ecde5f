"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on a bounded sample. It labels every byte
of a text; a text's probabilities are the mean of its positions'. Texts are read in windows
of WINDOW bytes, all of them, so long texts need no long recurrences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm._cluster import crc_mod, n_buckets
from siltstone.llm._words import slices
from siltstone.llm.repeats import utf8

HIDDEN, WINDOW = 8, 64
#: Documents of each language that the fit reads at most, chosen by a hash of their id.
FIT_DOCS = 300
#: Windows run side by side when predicting.
BLOCK = 4096
UNKNOWN = "und"


def _gate(x: np.ndarray) -> np.ndarray:
    """Piecewise linear sigmoid."""
    return np.clip(0.25 * x + 0.5, 0.0, 1.0)


@dataclass
class Network:
    """Per direction: input table (256, 3H) and recurrent matrix (H, 3H); output (2H, L) and bias."""

    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    languages: list[str]

    def weights(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recurrent, self.out, self.bias]

    def positions(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities (T, L, N) of every byte of windows (N, T)."""
        n, steps = windows.shape
        h_size = self.out.shape[0] // 2
        logits = np.repeat(self.bias[None, :, None], steps, 0).repeat(n, 2)
        columns = np.ascontiguousarray(windows.T)
        for d in (0, 1):
            table = np.ascontiguousarray(self.inputs[d].T)
            u_t, v_t = np.ascontiguousarray(self.recurrent[d].T), np.ascontiguousarray(self.out[d * h_size : (d + 1) * h_size].T)
            h = np.zeros((h_size, n), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                a, u = table.take(columns[t], axis=1), u_t @ h
                gates = a[: 2 * h_size]
                gates += u[: 2 * h_size]
                gates *= np.float32(0.25)
                gates += np.float32(0.5)
                np.clip(gates, 0.0, 1.0, out=gates)
                cand = u[2 * h_size :]
                cand *= gates[:h_size]
                cand += a[2 * h_size :]
                np.tanh(cand, out=cand)
                h -= cand
                h *= gates[h_size:]
                h += cand
                logits[t] += v_t @ h
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    def pooled(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Mean probabilities (n, L) of each text over its bytes, and bytes given to each language (n, L)."""
        if not self.languages:
            return np.zeros((len(texts), 0)), np.zeros((len(texts), 0), np.int64)
        data, bounds = utf8(texts)
        size = np.diff(bounds)
        per = -(-size // WINDOW)
        text = np.repeat(np.arange(len(size)), per)
        start = bounds[text] + (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * WINDOW
        used = np.minimum(bounds[text + 1] - start, WINDOW)
        n_lang = len(self.languages)
        total, votes = np.zeros((len(size), n_lang)), np.zeros((len(size), n_lang), np.int64)
        padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
        for i in range(0, len(text), BLOCK):
            s, u, of = start[i : i + BLOCK], used[i : i + BLOCK], text[i : i + BLOCK]
            inside = np.arange(WINDOW) < u[:, None]
            windows = np.where(inside, padded[s[:, None] + np.arange(WINDOW)], 0)
            p = self.positions(windows) * inside.T[:, None, :]
            best = p.argmax(1)
            for lang in range(n_lang):
                total[:, lang] += np.bincount(of, weights=p[:, lang].sum(0, dtype=np.float64), minlength=len(size))
                votes[:, lang] += np.bincount(of, weights=((best == lang) & inside.T).sum(0), minlength=len(size)).astype(np.int64)
        return total / np.maximum(size, 1)[:, None], votes

    def predict(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """id_col, lang_pred, score, probabilities and positions (maps by language) of every row.

        A null text, or one without a letter, is `und` with score 0 and empty maps. Ties go to
        the first language in code point order. Rows are judged alone.
        """
        rows = docs.select(F.col(id_col).alias("id"), F.when(F.col(text_col).rlike("\\p{L}"), F.col(text_col)).alias("text"))
        kind = rows.schema["id"].dataType.simpleString()
        names = self.languages

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, "text"):
                    text = batch.column("text")
                    known = np.asarray(text.is_valid()) & bool(names)
                    p, votes = self.pooled(text)
                    best = p.argmax(1) if names else np.zeros(len(text), int)
                    maps = lambda v, kind: pa.array([list(zip(names, map(kind, r), strict=True)) if k else [] for r, k in zip(v.tolist(), known, strict=True)], pa.map_(pa.string(), pa.float64() if kind is float else pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id"), pa.array([names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], pa.string()),
                         pa.array(np.where(known, p.max(1) if names else 0.0, 0.0)), maps(p, float), maps(votes, int)],
                        ["id", "lang_pred", "score", "probabilities", "positions"],
                    )

        schema = f"id {kind}, lang_pred string, score double, probabilities map<string,double>, positions map<string,long>"
        return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _forward(windows: np.ndarray, table: np.ndarray, u_mat: np.ndarray) -> list[tuple]:
    n, steps = windows.shape
    size = u_mat.shape[0]
    h, kept = np.zeros((n, size), np.float32), []
    for t in range(steps):
        a, u = table[windows[:, t]], h @ u_mat
        gates = _gate(a[:, : 2 * size] + u[:, : 2 * size])
        r, z = gates[:, :size], gates[:, size:]
        cand = np.tanh(a[:, 2 * size :] + r * u[:, 2 * size :])
        new = z * h + (1 - z) * cand
        kept.append((h, r, z, u[:, 2 * size :], cand, new))
        h = new
    return kept


def _backward(windows: np.ndarray, kept: list[tuple], d_out: np.ndarray, table: np.ndarray, u_mat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input table and recurrent matrix, through all steps from last to first."""
    size = u_mat.shape[0]
    d_u = np.zeros_like(u_mat)
    d_a = np.empty((windows.shape[1], windows.shape[0], 3 * size), np.float32)
    d_h = np.zeros((windows.shape[0], size), np.float32)
    slope = lambda g: 0.25 * ((g > 0) & (g < 1))
    for t in range(windows.shape[1] - 1, -1, -1):
        h, r, z, un, cand, _ = kept[t]
        d = d_h + d_out[t]
        pre = d * (1 - z) * (1 - cand * cand)
        d_r, d_z = pre * un * slope(r), d * (h - cand) * slope(z)
        back = np.concatenate([d_r, d_z, pre * r], 1)
        d_a[t] = np.concatenate([d_r, d_z, pre], 1)
        d_u += h.T @ back
        d_h = d * z + back @ u_mat.T
    flat, at = d_a.reshape(-1, 3 * size), windows.T.reshape(-1)
    order = np.argsort(at, kind="stable")
    d_table = np.zeros_like(table)
    seen, first = np.unique(at[order], return_index=True)
    d_table[seen] = np.add.reduceat(flat[order], first, 0)
    return d_table, d_u


def train(texts: list[str], langs: list[str], steps: int = 320, batch: int = 96, rate: float = 0.015, seed: int = 7) -> Network:
    """Adam on random windows, languages in equal parts; windows may lie anywhere in a text.

    The loss is the mean cross-entropy over all positions. Without texts the network knows no
    language.
    """
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    normal = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    net = Network([normal(256, 3 * HIDDEN) for _ in "fb"], [normal(HIDDEN, 3 * HIDDEN) for _ in "fb"], normal(2 * HIDDEN, len(names)), np.zeros(len(names), np.float32), names)
    pools = [np.frombuffer(b"\n".join(t.encode("utf-8", "replace") for t, x in zip(texts, langs, strict=True) if x == name) + bytes(WINDOW), np.uint8) for name in names]
    weights = net.weights()
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1 if names else 0):
        label = rng.integers(len(names), size=batch)
        windows = np.stack([pools[k][(s := rng.integers(len(pools[k]) - WINDOW + 1)) : s + WINDOW] for k in label])
        both = [windows, windows[:, ::-1]]
        runs = [_forward(w, net.inputs[d], net.recurrent[d]) for d, w in enumerate(both)]
        states = [np.stack([k[5] for k in runs[0]]), np.stack([k[5] for k in runs[1]])[::-1]]
        hidden = np.concatenate(states, 2)
        logits = hidden @ net.out + net.bias
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        p[:, np.arange(batch), label] -= 1
        p /= batch * WINDOW
        d_hidden = p @ net.out.T
        grads_in, grads_rec = zip(
            _backward(both[0], runs[0], d_hidden[:, :, :HIDDEN], net.inputs[0], net.recurrent[0]),
            _backward(both[1], runs[1], d_hidden[::-1, :, HIDDEN:], net.inputs[1], net.recurrent[1]),
            strict=True,
        )
        grads = [*grads_in, *grads_rec, np.einsum("tnh,tnl->hl", hidden, p, optimize=True), p.sum((0, 1))]
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (1 - 0.9 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = FIT_DOCS) -> Network:
    """A network fitted on at most `per_language` documents of each language of `docs`.

    Rows with a null id, text or language, and texts without a letter, are left out. Which
    rows may be learned from is the caller's choice. Repeated rows count once; an id with several
    texts counts with each of them.
    """
    usable = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    usable = usable.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    # a sample of each of some parts of a language, then of what is left: no task numbers a whole language
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_buckets(docs.sparkSession))).cast("int")
    order = [F.xxhash64("id"), F.col("id"), F.col("th")]
    ids = usable.select("id", "lang", F.xxhash64("text").alias("th")).distinct().withColumn("part", part)
    for keys in (["lang", "part"], ["lang"]):
        ids = ids.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= per_language)
    # a row for each of the sample's documents: bounded by per_language
    ids = ids.select("id", "lang", "th")
    sample = usable.withColumn("th", F.xxhash64("text")).join(F.broadcast(ids), ["id", "lang", "th"]).dropDuplicates(["id", "lang", "th"]).select("id", "lang", "text").toArrow()
    rows = sorted(zip(sample.column("lang").to_pylist(), map(str, sample.column("id").to_pylist()), sample.column("text").to_pylist(), strict=True))
    return train([r[2] for r in rows], [r[0] for r in rows])


def op7(docs: DataFrame) -> DataFrame:
    """The contract's columns: learns from ids whose crc32 mod 4 is not 2, predicts all of `documents`."""
    network = fit(docs.where(crc_mod("doc_id", 4) != 2))
    return network.predict(docs).select(
        "doc_id",
        F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )
