"""Byte-level BPE ids of texts, with frequent chunks looked up."""

from __future__ import annotations

import os
from array import array

import numpy as np

SPECIAL = "<|endoftext|>"
_SPACE = "\u0120"   # stands for a space in the vocabulary
# Bound of the looked-up chunks of a worker, by an estimate of their bytes.
CACHE_BYTES = 160 << 20
_ENTRY = 230        # key and value objects and their place in the table
_tokenizers: dict[str, "ChunkTokenizer"] = {}     # of this worker, for its next task of the same kind


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class _Chunks(dict):
    """Ids of chunks; a lookup of one that is not here moves it over from
    ``older``, or leaves in ``new`` an empty array to be filled with its ids."""

    def __init__(self, older: dict[str, bytes]) -> None:
        super().__init__()
        self.older = older
        self.new: dict[str, bytearray] = {}
        self.size = 0

    def __missing__(self, part: str) -> bytes | bytearray:
        ids = self.new.get(part)
        if ids is not None:
            return ids
        ids = self.older.get(part)
        if ids is None:
            ids = self.new[part] = bytearray()
            return ids
        self.size += _ENTRY + len(part) + len(ids)
        self[part] = ids
        return ids


class ChunkTokenizer:
    """Ids as little-endian bytes, chunk by chunk.  A single space between two
    other characters that are no white space always starts a new unit of the
    tokenizer's pattern, so a text is the sum of its chunks and frequent chunks
    are looked up.  Texts with other white space next to a space, or with a
    special token's string, are encoded whole.

    Chunks are kept in two generations: when the younger one reaches half of
    the bound it becomes the older one, and chunks met again move over."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)     # ids that begin with a space
        self.spaced[[i for token, i in vocabulary.items() if token.startswith(_SPACE)]] = True
        self.limit = cache_bytes // 2
        self.known = _Chunks({})

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of each part after a space: of all in one text, cut before the
        ids that begin with a space, since parts hold none."""
        ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(parts)], add_special_tokens=False)[0].ids, dtype="<u4")
        at = np.flatnonzero(self.spaced[ids])
        if len(at) != len(parts) or at[0] != 0:
            return self._encode([" " + p for p in parts])
        raw, ends = ids.tobytes(), (4 * np.append(at, len(ids))).tolist()
        return [raw[a:z] for a, z in zip(ends, ends[1:])]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of ASCII words after a space, each of which is one unit of the
        pattern, its bytes the model's own characters."""
        tokenize = self.tokenizer.model.tokenize
        return [array("I", [t.id for t in tokenize(_SPACE + w)]).tobytes() for w in words]

    def _learn(self) -> None:
        """Fill the arrays of the new chunks, and keep their ids."""
        known, new = self.known, self.known.new
        known.new = {}
        words = [p for p in new if p.isascii() and p.isalpha()]
        parts = [p for p in new if not (p.isascii() and p.isalpha())]
        for some, encode in [(words, self._encode_words)] + [
                (parts[i:i + 2_000], self._encode_parts) for i in range(0, len(parts), 2_000)]:
            ids = encode(some)
            for part, raw in zip(some, ids):
                new[part] += raw
            known.update(zip(some, ids))
            known.size += _ENTRY * len(some) + sum(map(len, some)) + sum(map(len, ids))

    def _apart(self, text: str) -> bool:
        """Whether all white space in a text is single and inside."""
        if text.isprintable():              # no white space but spaces
            return bool(text) and "  " not in text and text[0] != " " and text[-1] != " " and " " in text
        words = text.split()
        return len(words) > 1 and len(text) - len("".join(words)) + 1 == len(words)

    def ids(self, texts: list[str]) -> list[bytes]:
        """The first chunk of each text is encoded, the others, all of which
        begin with a space, are looked up by what follows it."""
        if self.known.size > self.limit:
            self.known.older = {}
            self.known = _Chunks(self.known)
        look_up = self.known.__getitem__
        heads: list[str] = []
        tails: list[list] = []              # ids of each chunk, some in arrays that are filled once all are found
        for text in texts:
            if SPECIAL in text or not self._apart(text):
                heads.append(text)
                tails.append([])
                continue
            parts = text.split(" ")
            heads.append(parts.pop(0))
            tails.append(list(map(look_up, parts)))
        self._learn()
        return [head + b"".join(tail) for head, tail in zip(self._encode(heads), tails)]

    @property
    def size(self) -> int:
        return self.known.size

    def forget(self) -> None:
        self.known = _Chunks({})


def tokenizer(path: str, cache_bytes: int = CACHE_BYTES) -> ChunkTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    _tokenizers[path].limit = cache_bytes // 2
    return _tokenizers[path]


def forget() -> None:
    """Drop the chunks of this worker."""
    for t in _tokenizers.values():
        t.forget()
