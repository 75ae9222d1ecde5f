"""Token ids of words under public vocabularies, remembered per Python worker up to a bound."""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa

from siltstone.llm._words import spread, word_list

#: Words remembered at most per worker and encoder.
MOST_WORDS = 150_000
#: Words encoded in one call.
TOGETHER = 4000


class _Generation:
    """Words and their ids, one after the other in `flat`."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.first, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.flat, self.used = np.zeros(4096, np.int32), 0

    def add(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.at)
        while n + len(words) > len(self.first):
            self.first, self.size = np.concatenate([self.first] * 2), np.concatenate([self.size] * 2)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat] * 2)
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[n : n + len(words)] = sizes
        self.first[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.at.update(zip(words, range(n, n + len(words)), strict=True))


class WordMemo:
    """Ids of single words: encoded once, then looked up.

    `encode` returns the sizes and the ids of a list of words. Memory is in two generations:
    when the newer one is full it becomes the older one, and words seen again move over, so
    that frequent words stay.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = MOST_WORDS):
        self.encode, self.most = encode, most
        self.new, self.old = _Generation(), _Generation()

    def runs(self, vocabulary: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word of the vocabulary its first place and size in the third array."""
        words = vocabulary if isinstance(vocabulary, list) else word_list(vocabulary)
        if len(self.new.at) + len(words) > self.most // 2:
            self.new, self.old = _Generation(), self.new
        new, old = self.new, self.old
        found = list(map(new.at.get, words))
        missing = [w for w, at in zip(words, found, strict=True) if at is None]
        if not missing:
            places = np.array(found, np.int64)
            return new.first[places], new.size[places], new.flat
        again = [w for w in missing if w in old.at]
        if again:
            places = np.fromiter(map(old.at.__getitem__, again), np.int64, len(again))
            new.add(again, old.size[places], spread(places, old.first, old.size, old.flat)[0])
            missing = [w for w in missing if w not in old.at]
        for i in range(0, len(missing), TOGETHER):
            part = missing[i : i + TOGETHER]
            new.add(part, *self.encode(part))
        places = np.fromiter(map(new.at.__getitem__, words), np.int64, len(words))
        return new.first[places], new.size[places], new.flat


def _listed(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), np.int32, len(ids))
    return sizes, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))


_memos: dict[tuple[str, str], WordMemo] = {}


# Fixed value: the split that the shortcut below stands in for.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Words of ASCII and composed Latin letters: lower-casing goes letter by letter and composition
#: changes nothing, so the split needs no Unicode tables.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ɏ]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ɏ]+|[0-9]|[^a-zß-öø-ɏ0-9]+")


class _Mapped(dict):
    """Characters beyond ASCII as the byte-level alphabet writes them; ASCII stays."""

    def __init__(self, to_bytes) -> None:
        self.to_bytes = to_bytes

    def __missing__(self, code: int) -> str:
        self[code] = self.to_bytes.pre_tokenize_str(chr(code))[0][0]
        return self[code]


class _PartEncoder:
    """Encodes words part by part under a lower-casing byte-level BPE, remembering the parts."""

    def __init__(self, tokenizer, most: int = MOST_WORDS // 2):
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole, self.model, self.most = tokenizer, tokenizer.model, most
        self.table = _Mapped(ByteLevel(add_prefix_space=False, use_regex=False))
        self.parts: dict[str, list[int]] = {}
        config = json.loads(tokenizer.to_str())
        steps = [x.get("type") for x in (config["normalizer"] or {}).get("normalizers", [])]
        splits = (config["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.known = steps == ["NFC", "Replace", "Lowercase"] and splits[0].get("pattern") == {"Regex": _SPLIT} and len(splits) == 2 and splits[1].get("type") == "ByteLevel"

    def part(self, text: str) -> list[int]:
        return [t.id for t in self.model.tokenize(text if text.isascii() else text.translate(self.table))]

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > self.most:
            self.parts.clear()
        out, parts = [], self.parts
        for word in words:
            if self.known and word.isascii() and word.isalpha():  # one part
                low = word.lower()
                ids = parts.get(low)
                if ids is None:
                    ids = parts[low] = self.part(low)
                out.append(ids)
                continue
            if not self.known or not _PLAIN.fullmatch(word) or "<|" in word:
                out.append(self.whole.encode(word, add_special_tokens=False).ids)
                continue
            ids = []
            for text in _PARTS.findall(word.lower()):
                got = parts.get(text)
                if got is None:
                    got = parts[text] = self.part(text)
                ids += got
            out.append(ids)
        return _listed(out)


def word_bpe(path: str) -> WordMemo:
    """Memo of a tokenizer file whose pre-tokenizer drops white space.

    Its splits never cross white space and its normaliser looks at single characters and
    combining sequences only, so the ids of a text are those of its words in order. Added
    tokens are looked for in the text as the library does by default.
    """
    if ("bpe", path) not in _memos:
        from tokenizers import Tokenizer

        _memos["bpe", path] = WordMemo(_PartEncoder(Tokenizer.from_file(path)))
    return _memos["bpe", path]


def byte_fallback(path: str) -> tuple[WordMemo, np.ndarray]:
    """Memo of a sentencepiece model with byte fallback, and which of its ids stand for single bytes."""
    if ("piece", path) not in _memos:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        _memos["piece", path] = WordMemo(lambda words: _listed(model.encode(words, num_threads=1)))
        _memos["piece", path].is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
    memo = _memos["piece", path]
    return memo, memo.is_byte


def forget_words() -> None:
    """Let go of this worker's memos. Spark reuses workers, so a stage after one that encodes
    words would hold them beside its own arrays; who encodes again starts a new memo."""
    if _memos:
        _memos.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def public_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
