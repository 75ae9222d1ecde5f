"""Language and encoding filter: hashed character n-grams under a multinomial naive Bayes model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import slices

#: Characters of a gram, and the buckets that grams are hashed to.
GRAM, BUCKETS = 3, 4096
#: Texts that were decoded wrongly: UTF-8 read as one byte a character, replacement characters.
MOJIBAKE = "Ã[\\x80-\\xBF]|â€|�"


@dataclass
class LanguageModel:
    """Languages in order, and for each the logarithm of each bucket's probability."""

    languages: list[str]
    logs: np.ndarray

    def table(self, spark) -> DataFrame:
        """(lang, bucket, log) of the model, as rows."""
        rows = [(lang, b, float(x)) for lang, logs in zip(self.languages, self.logs, strict=True) for b, x in enumerate(logs)]
        return spark.createDataFrame(rows, "lang string, bucket int, log double")


def gram_buckets(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every gram of all texts, and where each text's grams start (n + 1).

    A gram of the code points a, b, c (A-Z folded) has the bucket (961 a + 31 b + c) mod buckets.
    """
    lowered = pc.ascii_lower(pc.fill_null(texts, ""))
    sizes = pc.utf8_length(lowered).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(lowered.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    ends = np.cumsum(sizes)
    if len(points) < GRAM:
        return np.zeros(0, np.int64), np.zeros(len(sizes) + 1, np.int64)
    found = (961 * points[:-2] + 31 * points[1:-1] + points[2:]) % buckets
    # grams that would cross into the next text
    inside = np.ones(len(found), bool)
    for back in (1, 2):
        at = ends - back
        inside[at[(sizes >= back) & (at < len(found))]] = False
    starts = np.concatenate([[0], np.cumsum(np.maximum(sizes - GRAM + 1, 0))])
    return found[inside], starts


def train_languages(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", buckets: int = BUCKETS) -> LanguageModel:
    """A model of all rows with a language; one is added to each bucket's count.

    Buckets are counted inside each part of a batch, and summed in each task, so what is shuffled is
    a row for each task, language and bucket, and what reaches the driver is one for each language
    and bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            found, starts = gram_buckets(batch.column("text"), buckets)
            lang = batch.column("lang").dictionary_encode()
            key = np.repeat(np.asarray(lang.indices).astype(np.int64), np.diff(starts)) * buckets + found
            keys, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(keys // buckets)), pa.array((keys % buckets).astype(np.int32)), pa.array(n)], ["lang", "bucket", "n"])

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counted["lang"].to_pylist()))
    counts = np.zeros((len(langs), buckets))
    counts[[langs.index(x) for x in counted["lang"].to_pylist()], counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return LanguageModel(langs, np.log((counts + 1) / (counts.sum(1, keepdims=True) + buckets)))


def guess_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, guess, margin, mojibake): the likeliest language, by how much, and broken encodings.

    margin is the mean difference of a gram's log-probability to the second language; it is null
    with one language. A text without grams, or null, has neither guess nor margin; ties go to the
    smaller name. Every row is judged by itself.
    """
    buckets = model.logs.shape[1]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            found, starts = gram_buckets(batch.column("text"), buckets)
            n = np.diff(starts)
            sums = np.zeros((len(model.languages), len(n)))
            for i, logs in enumerate(model.logs):
                upto = np.concatenate([[0.0], np.cumsum(logs[found])])
                sums[i] = upto[starts[1:]] - upto[starts[:-1]]
            has = (n > 0) & (len(model.languages) > 0)
            best = sums.argmax(0) if len(sums) else np.zeros(len(n), int)
            order = np.sort(sums, 0)
            margin = (order[-1] - order[-2]) / np.maximum(n, 1) if len(sums) > 1 else np.zeros(len(n))
            names = pa.array(model.languages, pa.string()).take(pa.array(best, mask=~has)) if model.languages else pa.nulls(len(n), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), names, pa.array(margin, mask=~(has & (len(sums) > 1))), batch.column("mojibake")], ["id", "guess", "margin", "mojibake"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(MOJIBAKE), F.lit(False)).alias("mojibake"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(judge, f"id {kind}, guess string, margin double, mojibake boolean").withColumnRenamed("id", id_col)


def keep_languages(docs: DataFrame, model: LanguageModel, wanted: list[str], least_margin: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose ids (unique) are of a wanted language, clearly, and not broken."""
    judged = guess_language(docs, model, id_col, text_col)
    fine = judged.where(F.col("guess").isin(wanted) & (F.coalesce("margin", F.lit(float("inf"))) >= least_margin) & ~F.col("mojibake"))
    return docs.join(fine.select(id_col), id_col, "left_semi")
