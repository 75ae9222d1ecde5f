"""Chunks: recursive splitting by separators, inside articles where a text has them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import approx_tokens, chunk_id, strip, title
from siltstone.operators.structure import LEGAL, Patterns, articles, distinct_articles, page_begins, page_number, strip_noise
from siltstone.session import slices, written

SIZE, OVERLAP = 800, 150
# Separators from the strongest to none.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
_TOKEN = re.compile(r"\w+|[^\w\s]")


def token_length(text: str) -> int:
    return len(_TOKEN.findall(text))


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, length: Callable[[str], int] = len, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most `size` (unless a piece can not be cut), neighbours sharing up to `overlap`.

    The strongest separator in the text cuts it; each piece but the first starts with its
    separator. Short pieces are gathered into chunks, longer ones cut with what separators
    remain.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, weaker = separators[at], separators[at + 1 :]
    if separator:
        head, *rest = text.split(separator)
        pieces = [p for p in [head, *(separator + r for r in rest)] if p]
    else:
        pieces = list(text)
    chunks: list[str] = []
    short: list[str] = []
    for piece in pieces:
        if length(piece) < size:
            short.append(piece)
            continue
        chunks += _gather(short, size, overlap, length)
        short = []
        chunks += split_text(piece, size, overlap, length, weaker) if weaker else [piece]
    return chunks + _gather(short, size, overlap, length)


def _gather(pieces: list[str], size: int, overlap: int, length: Callable[[str], int]) -> list[str]:
    """Join neighbours up to `size`; each chunk starts with the end of the one before."""
    out: list[str] = []
    window: list[str] = []
    total = 0
    for piece in pieces:
        n = length(piece)
        if window and total + n > size:
            out.append("".join(window).strip())
            while window and (total > overlap or total + n > size):
                total -= length(window.pop(0))
        window.append(piece)
        total += n
    out.append("".join(window).strip())
    return [c for c in out if c]


def place_chunks(text: str, chunks: list[str]) -> list[int]:
    """Where each chunk starts, searched for from behind the start of the one before."""
    out, start = [], 0
    for chunk in chunks:
        found = text.find(chunk[:50], start)
        at = found if found >= 0 else start
        out.append(at)
        start = at + 1
    return out


def split_column(df: DataFrame, text_col: str, size: int = SIZE, overlap: int = OVERLAP, by_tokens: bool = False) -> DataFrame:
    """`df` with one row per chunk: text_col holds the chunk, `piece` its number, `at` its place."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, piece int, at long"
    length = token_length if by_tokens else len

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            texts, pieces, places, of = [], [], [], []
            for i, t in enumerate(batch.column(text_col).to_pylist()):
                chunks = split_text(t, size, overlap, length) if t else []
                texts += chunks
                pieces += range(len(chunks))
                places += place_chunks(t, chunks) if chunks else []
                of += [i] * len(chunks)
            out = batch.take(pa.array(of, pa.int64()))
            out = out.set_column(out.schema.get_field_index(text_col), text_col, pa.array(texts, pa.string()))
            yield out.append_column("piece", pa.array(pieces, pa.int32())).append_column("at", pa.array(places, pa.int64()))

    return df.mapInArrow(run, schema)


#: Longest first line that counts as a document's name.
LONGEST_NAME = 150


def chunk_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    overlap: int = OVERLAP,
    by_tokens: bool = False,
    patterns: Patterns = LEGAL,
    pages_col: str | None = None,
    name_col: str | None = None,
) -> DataFrame:
    """(id, chunk_index, chunk_id, text, char_count, law_name, article_number, section, page_number, start_offset).

    A document with articles gives one chunk per article, or several where it is over `size`;
    one without is split as a whole. With `pages_col` (array of strings) the text is that of the
    pages, and each chunk has the number of the page on which its article, or without articles
    the chunk, starts; null where a document has one page. law_name is the first line that is
    not blank, if it is short enough, else the file name in `name_col` without its suffix.
    """
    name = F.regexp_replace(F.col(name_col), "\\.[^.]*$", "") if name_col else F.lit(None).cast("string")
    whole = F.array_join(pages_col, "\n\n") if pages_col else F.col(text_col)
    pages = F.transform(pages_col, lambda x: strip_noise(x, patterns)) if pages_col else F.array(strip_noise(F.col(text_col), patterns))
    # names by the text as it was: boilerplate may be the first line; exploded, so that a text is cleaned once
    read = docs.select(F.col(id_col).alias("doc"), title(whole, name, LONGEST_NAME).alias("law_name"), F.explode(F.array(pages)).alias("pages"))
    begins = page_begins(F.col("pages")) if pages_col else F.lit(None).cast("array<bigint>")
    read = read.select("doc", "law_name", begins.alias("begins"), F.explode(F.array(F.array_join("pages", "\n\n"))).alias("text"))
    has_articles = F.exists(F.split("text", "\n"), lambda x: strip(x).rlike(patterns.article))
    none = F.lit(None).cast("string")
    # a text without articles stays in its row from the file to the chunks
    plain = split_column(read.where(~has_articles), "text", size, overlap, by_tokens)
    plain = plain.select("doc", F.col("piece").alias("chunk_index"), "text", "law_name", none.alias("article_number"), none.alias("section"), F.col("at").alias("offset"), "begins")
    # read more than once
    legal = written(read.where(has_articles), "legal")
    found = distinct_articles(articles(legal, "doc", "text", patterns), "doc")
    n = approx_tokens(F.col("text")) if by_tokens else F.length("text")
    chunks = found.where(n <= size).withColumn("piece", F.lit(0)).unionByName(split_column(found.where(n > size), "text", size, overlap, by_tokens).drop("at"))
    chunks = chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy("doc").orderBy("nth", "piece")) - 1)
    chunks = chunks.join(legal.select("doc", "law_name", "begins"), "doc")
    out = plain.unionByName(chunks.select("doc", "chunk_index", "text", "law_name", "article_number", "section", F.col("start_offset").alias("offset"), "begins"))
    return out.select(
        F.col("doc").alias(id_col), "chunk_index", chunk_id(F.col("doc"), F.col("chunk_index")).alias("chunk_id"), "text",
        F.length("text").alias("char_count"), "law_name", "article_number", "section", page_number("begins", "offset").alias("page_number"), F.col("offset").alias("start_offset"),
    )
