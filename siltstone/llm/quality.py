"""Quality rules: surface counts and tokeniser fertility.

Fertility of a text under public vocabularies: characters per token (a word-end BPE and a
byte-fallback BPE), the share of tokens that are bare bytes, and the entropy of its tokens.
Each script or language has a band for each; a text outside one is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm._pieces import byte_fallback, public_path, word_bpe
from siltstone.llm._words import SPACES, per_text, plain, slices, split_words, spread, word_list

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Tokens of a block whose entropy is taken. A longer text is judged by all its blocks: the
#: entropy of a text settles while the logarithm of its length grows.
BLOCK = 4096
WORD_VOCABULARY, BYTE_VOCABULARY = "word_bpe_49k.json", "piece_bpe_32k.model"


class Band(NamedTuple):
    """Limits a text must keep: characters per token and per piece, share of byte tokens, entropy."""

    min_chars: float
    max_chars: float
    max_bytes: float
    #: Entropy in bits over the bits that as many different tokens would have, in blocks of BLOCK tokens.
    min_evenness: float
    #: Characters per token of the second vocabulary, whose tokens fall back to bytes.
    min_piece_chars: float


# Bands by language where one is known, else by script. Logographic and unlisted scripts
# cost several byte tokens a character in these vocabularies, which is no fault of the text.
BANDS = {
    "en": Band(2.12, 7.0, 0.05, 0.40, 1.75),
    "de": Band(1.98, 7.0, 0.05, 0.40, 1.80),
    "fr": Band(1.80, 7.0, 0.05, 0.40, 1.60),
    "es": Band(1.77, 7.0, 0.05, 0.40, 1.60),
    "Latin": Band(1.60, 7.0, 0.10, 0.40, 1.40),
    "Cyrillic": Band(0.80, 7.0, 0.20, 0.40, 0.60),
    "Greek": Band(0.60, 6.0, 0.30, 0.40, 0.40),
    "other": Band(0.20, 6.0, 1.00, 0.40, 0.15),
}
_SCRIPTS = {"Latin": "AZ az ªª ºº Àɏ Ḁỿ", "Cyrillic": "Ѐԯ", "Greek": "ͰϿ ἀ῿"}

_FIELDS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "n_tokens": pa.int64(), "chars_per_token": pa.float64(), "chars_per_piece": pa.float64(), "byte_share": pa.float64(), "evenness": pa.float64(), "script": pa.string(),
}
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, chars_per_piece double, byte_share double, evenness double, script string"


def _kinds_of_characters() -> np.ndarray:
    """The kind of each character below 2**16: a number of _SCRIPTS, then other letters and signs, other ASCII, SYMBOLS."""
    kinds = np.full(1 << 16, len(_SCRIPTS), np.uint8)
    kinds[:128] = len(_SCRIPTS) + 1
    for k, ranges in enumerate(_SCRIPTS.values()):
        for first, last in ranges.split():
            kinds[ord(first) : ord(last) + 1] = k
    kinds[[ord(x) for x in SYMBOLS]] = len(_SCRIPTS) + 2
    return kinds


_KINDS = _kinds_of_characters()


def character_kinds(words: list[str]) -> np.ndarray:
    """How many characters of each kind each word has, a row a word."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.where(flat < len(_KINDS), _KINDS[np.minimum(flat, len(_KINDS) - 1)], len(_SCRIPTS)).astype(np.int64)
    n = int(_KINDS.max()) + 1
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    return np.bincount(owner * n + kinds, minlength=len(words) * n).reshape(-1, n)


def repeated_words(codes: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each text inside a window of `window` words (a power of two) that it holds twice or more."""
    n_texts, n = len(offsets) - 1, len(codes)
    counts = np.diff(offsets)
    if n == 0:
        return np.zeros(n_texts, np.int64)
    text = np.repeat(np.arange(n_texts), counts)
    # Numbers of ever longer runs: equal numbers, equal runs of words in the same text.
    _, run = np.unique(text * np.int64(int(codes.max()) + 1) + codes, return_inverse=True)
    size = 1
    while size < window and len(run) > size:
        _, run = np.unique(run[:-size] * np.int64(n + 1) + run[size:], return_inverse=True)
        size *= 2
    if size < window:
        return np.zeros(n_texts, np.int64)
    inside = text[: len(run)] == text[window - 1 :]
    run = run[inside]
    starts = np.flatnonzero(inside)[np.bincount(run)[run] > 1] if len(run) else run
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.bincount(text, weights=np.cumsum(edge[:n]) > 0, minlength=n_texts).astype(np.int64)


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def _evenness(ids: np.ndarray, bounds: np.ndarray, base: int) -> np.ndarray:
    """Mean over each text's blocks of BLOCK ids, weighted by their ids, of a block's entropy over the logarithm of how many it has.

    `base` is over every id. The last block is what remains; a block of one id has 1, and so
    has a text without ids. A text of one block is judged whole.
    """
    n = np.diff(bounds)
    blocks = -(-n // BLOCK)
    text = np.repeat(np.arange(len(n)), blocks)
    first = np.cumsum(blocks) - blocks
    inner = np.arange(len(text)) - first[text]
    held = np.minimum(n[text] - inner * BLOCK, BLOCK)
    cells, counts = np.unique(np.repeat(np.arange(len(held)), held) * np.int64(base) + ids, return_counts=True)
    p = counts / held[cells // base]
    bits = np.bincount(cells // base, weights=-p * np.log2(p), minlength=len(held))
    even = np.where(held > 1, bits / np.log2(np.maximum(held, 2)), 1.0)
    return np.where(n > 0, np.bincount(text, weights=even * held, minlength=len(n)) / np.maximum(n, 1), 1.0)


def measure(texts: pa.Array, word_path: str, byte_path: str) -> dict[str, pa.Array]:
    """All counts of _FIELDS for an array of texts."""
    x = plain(texts)
    codes, words, offsets = split_words(x)
    n_words = np.diff(offsets)
    text = np.repeat(np.arange(len(n_words)), n_words)
    total = lambda values: np.bincount(text, weights=values[codes], minlength=len(n_words)).astype(np.int64)
    listed = word_list(words)
    kinds = character_kinds(listed)
    word_chars = total(kinds.sum(1))

    memo, is_byte = byte_fallback(byte_path)
    first, size, flat = memo.runs(listed)
    pieces = total(size)
    ids, ends = spread(np.arange(len(words)), first, size, flat)
    byte_of_word = np.diff(np.concatenate([[0], np.cumsum(is_byte[ids])])[np.concatenate([[0], ends]).astype(np.int64)])
    byte_tokens = total(byte_of_word)

    ids, ends = spread(codes, *word_bpe(word_path).runs(listed))
    bounds = per_text(ends, offsets)
    tokens = np.diff(bounds)
    ratio = lambda a, b, none: np.where(b > 0, a / np.maximum(b, 1), none)

    per_script = np.stack([total(kinds[:, k]) for k in range(len(_SCRIPTS) + 1)])
    script = np.array([*_SCRIPTS, "other"])[np.argmax(per_script, axis=0)]
    return {
        "n_words": pa.array(n_words, pa.int64()),
        "word_chars": pa.array(word_chars),
        "n_symbols": pa.array(total(kinds[:, -1])),
        "n_dup_lines": pa.array([duplicate_lines(t) for t in x.to_pylist()], pa.int64()),
        "n_repeat_words": pa.array(repeated_words(codes, offsets)),
        "n_tokens": pa.array(tokens, pa.int64()),
        "chars_per_token": pa.array(ratio(word_chars, tokens, 0.0)),
        "chars_per_piece": pa.array(ratio(word_chars, pieces, 0.0)),
        "byte_share": pa.array(ratio(byte_tokens, pieces, 0.0)),
        "evenness": pa.array(_evenness(ids, bounds, 1 << 20)),
        "script": pa.array(script.tolist(), pa.string()),
    }


def judge(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str | None = "lang",
    bands: dict[str, Band] = BANDS,
    name: str = "quality",
    vocabularies: tuple[str, str] | None = None,
) -> DataFrame:
    """`docs` with a struct `name`: the counts, base_failed, band, rejected_by and kept.

    base_failed: under MIN_WORDS words, or over MAX_REPEAT_PERCENT % of them in repeated
    windows. rejected_by: the first measure outside its band, else null. kept: neither. The
    band is that of the language if listed, else of the script that most characters are in.

    All columns pass through (one called `name` is replaced). A null or empty text has no
    words and fails the base rule; its script is Latin. Rows are judged alone, so repeated
    rows get the same verdict, and an empty table gives an empty one.
    """
    word_path, byte_path = vocabularies or (public_path(WORD_VOCABULARY), public_path(BYTE_VOCABULARY))
    rows = docs.drop(name)
    schema = rows.schema
    at = schema.names.index(text_col)
    kind = pa.struct(list(_FIELDS.items()))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.schema.names[at]):
                found = measure(batch.column(at), word_path, byte_path)
                got = pa.StructArray.from_arrays([found[k].cast(t) for k, t in _FIELDS.items()], fields=list(kind))
                yield pa.RecordBatch.from_arrays([*batch.columns, got], [*batch.schema.names, name])

    widened = T.StructType([*schema.fields, T.StructField(name, T._parse_datatype_string(SCHEMA))])
    out = rows.mapInArrow(counts, widened)
    q = F.col(name)
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])
    known = F.create_map(*[x for k in bands for x in (F.lit(k), F.lit(k))])
    band = F.coalesce(F.try_element_at(known, F.coalesce(F.col(lang_col).cast("string"), F.lit(""))), q["script"]) if lang_col else q["script"]
    limit = lambda i: F.element_at(F.create_map(*[x for k, b in bands.items() for x in (F.lit(k), F.lit(float(b[i])))]), band)
    outside = (
        F.when(q["chars_per_token"] < limit(0), "few characters a token")
        .when(q["chars_per_token"] > limit(1), "many characters a token")
        .when(q["byte_share"] > limit(2), "byte tokens")
        .when(q["evenness"] < limit(3), "uniform tokens")
        .when(q["chars_per_piece"] < limit(4), "few characters a piece")
    )
    return (
        out.withColumn(name, q.withField("base_failed", failed).withField("band", band).withField("rejected_by", outside))
        .withColumn(name, q.withField("kept", ~F.col(f"{name}.base_failed") & F.col(f"{name}.rejected_by").isNull()))
    )


def op3(docs: DataFrame) -> DataFrame:
    """The contract's columns of judge() over `documents`, and what the method measured."""
    q = judge(docs.select("doc_id", "text", "lang")).select("doc_id", "quality.*")
    return q.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "chars_per_token", "chars_per_piece", "byte_share", "evenness", "band", "rejected_by",
    )
