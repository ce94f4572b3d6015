"""Words of Arrow text columns as 64-bit hashes, found for a whole batch with array operations.

A word is a run of bytes other than ASCII white space. Its hash is the sum of a random value of each byte times a power of
an odd number, taken as a difference of running sums and divided by the power of its first place, then mixed with its
length. A to Z count as a to z where asked. Nothing but the hash arrays and one slice of texts is held."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are split at a time, and of running sums; a longer text or word is taken whole.
SLICE, CHUNK = 2 << 20, 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_LOWER = bytes(range(256)).lower()


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@cache
def _bytes(fold_case: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
    if fold_case:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


@cache
def _powers(places: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd number and of its inverse; places is a power of two, so few sizes are kept."""
    out = []
    for base in (_ODD, pow(_ODD, -1, 1 << 64)):
        row = np.full(places, base, np.uint64)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


class Words(NamedTuple):
    """The words of some texts: data holds the texts' bytes; word i is data[starts[i]:ends[i]]; text j has the words from
    first[j] to first[j + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def text_offsets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each in them; a null has no bytes."""
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about so many bytes; a longer text is a run of its own.

    After each, what is free in Arrow's memory pool, which would keep it, is given back."""
    if not batch.num_rows:
        return
    _, offsets = text_offsets(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
        pa.default_memory_pool().release_unused()


def split(texts: pa.Array, fold_case: bool = True) -> Words:
    data, offsets = text_offsets(texts)
    none = np.empty(0, np.int64)
    if not len(data):
        return Words(data, none, none, np.zeros(len(texts) + 1, np.int64), np.empty(0, np.uint64))
    space = SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = edge[:-1].copy()
    before[1:] |= space[:-1]
    after = edge[1:].copy()
    after[:-1] |= space[1:]
    after[-1] = True
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), _hashes(data, starts, ends, _bytes(fold_case)))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        part = data[base : ends[to - 1]]
        up, down = _powers(1 << max(CHUNK.bit_length() - 1, (len(part) - 1).bit_length()))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * up[: len(part)], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(_ODD))
        at = to
    return out


def strings(words: Words, at: np.ndarray) -> pa.Array:
    """The words at those places, A to Z lower-cased."""
    size = (words.ends - words.starts)[at]
    offsets = np.append(0, np.cumsum(size))
    data = words.data[np.repeat(words.starts[at] - offsets[:-1], size) + np.arange(offsets[-1])].tobytes().translate(_LOWER)
    return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def shingles(words: Words, n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; fewer words than n are one shingle."""
    h, k, out = words.hashes, np.uint64(_ODD), []
    size = max(0, len(h) - n + 1)
    joint = h[:size].copy()
    for i in range(1, n):
        joint = mix(joint * k + h[i : i + size])
    first = words.first.tolist()
    for a, b in zip(first, first[1:]):
        if b - a >= n:
            s = joint[a : b - n + 1].copy()
            s.sort()
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        else:
            s = h[a : min(a + 1, b)].copy()
            for i in range(a + 1, b):
                s = mix(s * k + h[i : i + 1])
            s = mix(s + np.uint64(b - a))
        out.append(s)
    return out
