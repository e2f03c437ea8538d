"""Sets of hashed word shingles and their minima."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

from stratabar.llm.common import held_by_worker

#: Words of a shingle.
WORDS = 5
#: Distinct words whose hashes a worker remembers.
CACHE_WORDS = 400_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes. Words are runs of anything but ASCII white space; a text
    of fewer than WORDS words is one shingle; without words the set is empty."""
    words = (text or "").encode("utf-8", "replace").split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = held_by_worker("shingles", WordHashes)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(WORDS, len(h))
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        out = (out + h[i : i + n]) * _STEP
        out ^= out >> np.uint64(32)
    out *= _END
    return np.unique(out ^ (out >> np.uint64(29)))


def minima(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set, as 32-bit integers; zeros for an empty set."""
    if not len(shingles):
        return np.zeros(len(multipliers), np.int32)
    out = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        out = np.minimum(out, (multipliers[:, None] * shingles[None, at : at + 2048]).min(axis=1))
    return (out >> np.uint64(16)).astype(np.uint32).view(np.int32)


def intersections(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """The sizes of the intersections of each set of one bounded list with each of another."""
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = (np.concatenate([np.empty(0, np.uint64), *sets]) for sets in (left, right))
    shared = np.intersect1d(a, b)
    if not len(shared):
        return out
    places = []
    for flat, sets in ((a, left), (b, right)):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        own = shared[at] == flat
        order = np.argsort(at[own], kind="stable")
        places.append((at[own][order], owner[own][order]))
    for first in range(0, len(shared), columns):
        m = []
        for (at, owner), sets in zip(places, (left, right), strict=True):
            lo, hi = np.searchsorted(at, [first, first + columns])
            x = np.zeros((len(sets), min(columns, len(shared) - first)), np.float32)
            x[owner[lo:hi], at[lo:hi] - first] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


def sorted_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(key, rows) for batches sorted by their first column, an integer; a group may span batches."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        keys = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and keys[a] != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = int(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)
