"""Token ids of words, looked up in public vocabularies, once for each distinct word.

A task keeps a bounded cache of words it has seen, and gives it up at its end, since idle workers stay
in memory. The bound limits memory only: a word that is not in the cache is encoded again.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from itertools import chain

import numpy as np

from tessaline.llm.textkernel import Words, ragged, span_fingerprints

CACHE_WORDS = 600_000
#: Stands between words that are encoded together; it is a token of its own, and words that hold it are encoded alone.
PART = b"\x01"
_ENCODERS: dict[str, Callable[[list[bytes]], list[list[int]]]] = {}
_CACHES: dict[str, WordCache] = {}


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine; a path is taken as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encoder(name: str) -> Callable[[list[bytes]], list[list[int]]]:
    """A function from words to their ids. .json: tokenizers; .model: sentencepiece."""
    if name not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        path = vocabulary(name)
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            one = lambda text: t.encode(text, add_special_tokens=False).ids
            part = one(PART.decode())
            _ENCODERS[name] = lambda words: _together(words, one, part)
        else:
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_file=path)
            _ENCODERS[name] = lambda words: p.encode([w.decode() for w in words], num_threads=1)
    return _ENCODERS[name]


def _together(words: list[bytes], one: Callable[[str], list[int]], part: list[int]) -> list[list[int]]:
    """Encode words in one call, with the part between, which spares the cost of a call for each."""
    if len(part) != 1:
        return [one(w.decode()) for w in words]
    out: list[list[int]] = []
    for at in range(0, len(words), 4096):
        some = words[at : at + 4096]
        odd = {i: one(w.decode()) for i, w in enumerate(some) if PART in w}
        ids = one((b" " + PART + b" ").join([b"" if i in odd else w for i, w in enumerate(some)]).decode()) if len(odd) < len(some) else []
        flat = np.asarray(ids, dtype=np.uint32)
        cut = np.flatnonzero(flat == part[0])
        if len(odd) < len(some) and len(cut) != len(some) - 1:
            out += [one(w.decode()) for w in some]
            continue
        begin, end = [0, *(cut + 1).tolist()], [*cut.tolist(), len(ids)]
        out += [odd[i] if i in odd else ids[begin[i] : end[i]] for i in range(len(some))]
    return out


class WordCache:
    """Words are known by 128 bits: sorted first fingerprints, and the second ones to confirm them."""

    def __init__(self, name: str):
        self.encode = encoder(name)
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(0, dtype=np.uint64)
        self.check = np.zeros(0, dtype=np.uint64)
        self.begin = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0

    def _add(self, key: np.ndarray, check: np.ndarray, words: list[bytes]) -> None:
        found = self.encode(words)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        total = int(sizes.sum())
        if len(self.ids) < self.used + total:
            self.ids = np.concatenate([self.ids, np.zeros(max(total, len(self.ids)), dtype=np.uint32)])
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=total)
        begin = self.used + np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.used += total
        at = np.searchsorted(self.key, key)
        for name, new in (("key", key), ("check", check), ("begin", begin), ("size", sizes)):
            setattr(self, name, np.insert(getattr(self, name), at, new))

    def of(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes): the ids of all words one after another, and how many each has."""
        if not len(w.begin):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        if len(self.key) > CACHE_WORDS:
            self.clear()
        key, at, back = np.unique(w.fingerprints(), return_index=True, return_inverse=True)
        check = span_fingerprints(w.data, w.begin[at], w.end[at], 1)
        place = np.searchsorted(self.key, key)
        known = np.zeros(len(key), dtype=bool)
        inside = place < len(self.key)
        known[inside] = self.key[place[inside]] == key[inside]
        other = known.copy()
        other[known] = self.check[place[known]] != check[known]
        new = np.flatnonzero(~known)
        data = w.data.tobytes()
        cut = lambda which: [data[a:b] for a, b in zip(w.begin[at[which]].tolist(), w.end[at[which]].tolist())]
        if len(new):
            self._add(key[new], check[new], cut(new))
            place = np.searchsorted(self.key, key)
        begin, size, ids = self.begin[place], self.size[place], self.ids
        if other.any():  # another word has the same 64 bits: these few are encoded by themselves
            alone = np.flatnonzero(other)
            found = self.encode(cut(alone))
            size[alone] = [len(x) for x in found]
            begin[alone] = self.used + np.concatenate(([0], np.cumsum(size[alone])[:-1]))
            ids = np.concatenate([ids[: self.used], np.asarray([i for x in found for i in x], dtype=np.uint32)])
        sizes = size[back]
        return ids[ragged(begin[back], sizes)], sizes


def cache(name: str) -> WordCache:
    if name not in _CACHES:
        _CACHES[name] = WordCache(name)
    return _CACHES[name]
