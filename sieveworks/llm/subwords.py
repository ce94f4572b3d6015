"""Subword ids of words of Arrow text columns, for tokenizers that never join text across ASCII white space and drop it."""

from __future__ import annotations

import os
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa

from sieveworks.llm import wordhash
from sieveworks.llm.text import LOWER_ASCII

#: Distinct words whose ids a Python worker keeps; when full, those are forgotten that no later slice had.
KEPT_WORDS = 800_000
#: Bytes of text whose distinct words are looked up together.
SLICE = 2 << 20
#: New words that the library encodes in one call; it needs over a kilobyte for each.
AT_ONCE = 2048


@cache
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordMemory:
    """The library's ids of distinct words, by hash; a word seen before is not encoded again. Words that are whole (sorted hashes)
    have one id each instead, from the vocabulary's size on."""

    def __init__(self, path: str, kind: str, whole: np.ndarray | None = None):
        self.tokenizer, self.kind, self.whole = load(path), np.dtype(kind), np.empty(0, np.uint64) if whole is None else whole
        self.keys, self.begin, self.size = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32)
        self.pool, self.met = np.empty(0, self.kind), np.empty(0, bool)

    def _pooled(self, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words at those places of the pool, one after another, and where those of each end (after a 0)."""
        ends = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        pool = self.pool if len(self.pool) else np.zeros(1, self.kind)  # whole words take any place
        return pool[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])], ends

    def _forget(self) -> None:
        """Keeps the words that were met again since the last time."""
        kept = np.flatnonzero(self.met)
        self.pool, ends = self._pooled(self.begin[kept], self.size[kept])
        self.keys, self.begin, self.size, self.met = self.keys[kept], ends[:-1].astype(np.int32), self.size[kept], np.zeros(len(kept), bool)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        size, pools = np.empty(len(texts), np.int32), [self.pool]
        for i in range(0, len(texts), AT_ONCE):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + AT_ONCE], add_special_tokens=False)]
            size[i : i + AT_ONCE] = [len(f) for f in found]
            pools.append(np.fromiter(chain.from_iterable(found), self.kind, int(size[i : i + AT_ONCE].sum())))
        begin = (np.cumsum(size, dtype=np.int64) - size + len(self.pool)).astype(np.int32)
        self.pool = np.concatenate(pools)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.size, self.met = (np.insert(old, at, new) for old, new in ((self.keys, keys), (self.begin, begin), (self.size, size), (self.met, False)))

    @staticmethod
    def _find(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(among):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
        return at, among[at] == keys

    def __call__(self, texts: pa.Array, fold_case: bool = False) -> tuple[np.ndarray, np.ndarray, wordhash.Words]:
        """The ids of all texts, one after another, where the ids of each word end (after a 0), and the words."""
        words = wordhash.split(texts, fold_case)
        keys, first, kind = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.keys) > KEPT_WORDS:
            self._forget()
        one, whole = self._find(keys, self.whole)
        at, known = self._find(keys, self.keys)
        self.met[at[known]] = True
        known |= whole
        if not known.all():
            data, new = words.data.tobytes(), first[~known]
            own = [data[a:b].decode("utf-8", "replace") for a, b in zip(words.starts[new].tolist(), words.ends[new].tolist(), strict=True)]
            self._learn(keys[~known], [w.translate(LOWER_ASCII) for w in own] if fold_case else own)
            at, _ = self._find(keys, self.keys)
        begin, size = (np.where(whole, 0, old[at] if len(old) else 0) for old in (self.begin, self.size))
        size[whole] = 1
        ids, ends = self._pooled(begin[kind], size[kind])
        if whole.any():
            whole = whole[kind]
            ids[ends[:-1][whole]] = self.tokenizer.get_vocab_size() + one[kind[whole]]
        return ids, ends, words


@cache
def memory(path: str, kind: str) -> WordMemory:
    """One for each Python worker, so that it serves all tasks that the worker runs."""
    return WordMemory(path, kind)
