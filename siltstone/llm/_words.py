"""Words of whole Arrow batches, kept in columns: one code per word and each word's text once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Space and U+0009..U+000D; everything else belongs to words.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD_SQL = "[^\\x20\\x09-\\x0D]+"


def plain(texts: pa.Array) -> pa.Array:
    """The texts with null as the empty string."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts, "")


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batch of about `most` bytes of text at most, or of a single row."""
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all words in order, the vocabulary they index, and where each text starts (n + 1)."""
    x = plain(texts)
    for c in SPACES[1:]:
        x = pc.replace_substring(x, c, " ")
    parts = pc.split_pattern(x, " ")
    flat = parts.flatten().dictionary_encode()
    codes = np.asarray(flat.indices)
    bounds = np.asarray(parts.offsets) - parts.offsets[0].as_py()
    empty = pc.index(flat.dictionary, "").as_py()
    held = codes != empty
    upto = np.zeros(len(codes) + 1, dtype=np.int64)
    np.cumsum(held, out=upto[1:])
    return codes[held].astype(np.int64), flat.dictionary, upto[bounds]


def word_list(vocabulary: pa.Array) -> list[str]:
    """The words as Python strings; by way of NumPy, which is several times faster than one by one."""
    return vocabulary.to_numpy(zero_copy_only=False).tolist()


def spread(codes: np.ndarray, first: np.ndarray, size: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code's run flat[first:first + size], one after the other; and the running end of each."""
    n = size[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64) - np.repeat(ends - n, n) + np.repeat(first[codes], n)
    return flat[at], ends


def per_text(ends: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Text boundaries (n + 1) in what spread() returned, from boundaries in words."""
    return np.concatenate([[0], ends])[offsets].astype(np.int64)


def cut_words(texts: pa.Array, spaces: str = SPACES, breaks: str = "", lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Codes of all words, their vocabulary, where each text starts (n + 1), and the piece of each word.

    Words are what the ASCII characters of `spaces` and `breaks` part; pieces are numbered
    through all texts, and a break or a text's end parts them. `lower` folds A-Z. Works on the
    texts' bytes, on which ASCII characters stand for themselves alone.
    """
    x = plain(texts).cast(pa.large_string())
    ends = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
    data = np.frombuffer(x.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(x) else np.zeros(0, np.uint8)
    edges = ends - ends[0] if len(x) else np.zeros(1, np.int64)
    kinds = np.zeros(256, np.uint8)
    kinds[list(spaces.encode())], kinds[list(breaks.encode())] = 1, 2
    kind = kinds[data]
    held = kind == 0
    begins, closes = held.copy(), held.copy()
    begins[1:] &= ~held[:-1]
    closes[:-1] &= ~held[1:]
    inner = edges[(edges > 0) & (edges < len(data))]
    begins[inner] = held[inner]
    closes[inner - 1] = held[inner - 1]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(closes) + 1 - starts
    kept = data[held]
    if lower:
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        kept = fold[kept]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))])
    coded = words.dictionary_encode()
    bounds = np.searchsorted(starts, edges)
    parted = np.zeros(len(starts) + 1, np.int64)
    parted[bounds[1:-1]] = 1  # a text begins here, or several where some have no word
    if breaks:
        passed = np.cumsum(kind == 2)[starts]
        parted[1:-1] |= np.diff(passed) > 0
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary.cast(pa.string()), bounds.astype(np.int64), np.cumsum(parted[:-1])
