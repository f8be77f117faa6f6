"""Word shingles and SuperMinHash signatures of whole texts, in numpy.

A word is a run of ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased, which is what
``bytes.lower().split()`` gives on UTF-8.  A text's shingle set holds the distinct
runs of ``width`` words; a text with fewer words has its whole sequence as its one
shingle; a text without words (or a null text) has the empty set.
"""

from __future__ import annotations

import numpy as np
import xxhash

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S32 = (np.uint64(n) for n in (30, 27, 31, 32))
_LOW = np.uint64(0xFFFFFFFF)
#: Value of a signature slot that no shingle has reached.
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, remembered for up to ``limit`` words."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, memo: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of one whole text."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    take = min(width, len(words))
    state = np.full(len(words) - take + 1, take, np.uint64) * _GOLD
    for i in range(take):
        state = mix64(state + hashes[i : len(hashes) - take + 1 + i])
    return np.unique(state)


def superminhash(sets: list[np.ndarray], slots: int = 128) -> np.ndarray:
    """SuperMinHash signatures, one row of ``slots`` values for each set.

    Every element walks its own random permutation of the slots (a Fisher-Yates
    shuffle driven by a counter-based generator); at step ``j`` it offers its slot the
    value ``j + r`` with ``r`` in [0, 1), kept here as the integer ``j << 32 | r``.
    Steps run in layers over all elements at once.  A later step can only offer larger
    values, so a set stops as soon as its slots are all taken: the early stop.
    Elements of an empty set leave the row at EMPTY.
    """
    if not 2 <= slots <= 256:
        raise ValueError("slots must be between 2 and 256")
    count = len(sets)
    out = np.full(count * slots, EMPTY, np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return out.reshape(count, slots)
    seeds = np.concatenate(sets).astype(np.uint64, copy=False)
    base = np.repeat(np.arange(count, dtype=np.int64) * slots, sizes)
    perm = rows = None
    for layer in range(slots):
        draw = mix64(seeds + np.uint64((layer + 1) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
        pick = layer + (((draw & _LOW) * np.uint64(slots - layer)) >> _S32).astype(np.int64)
        value = (draw >> _S32) | (np.uint64(layer) << _S32)
        if perm is None:
            slot = pick
        else:
            slot = perm[rows, pick].astype(np.int64)
            perm[rows, pick] = perm[rows, layer]
        np.minimum.at(out, base + slot, value)
        if layer == slots - 1:
            break
        open_sets = (out.reshape(count, slots) == EMPTY).any(axis=1) & (sizes > 0)
        if not open_sets.any():
            break
        keep = open_sets[base // slots]
        if perm is None:
            seeds, base, first = seeds[keep], base[keep], pick[keep]
            rows = np.arange(len(seeds))
            perm = np.broadcast_to(np.arange(slots, dtype=np.uint8), (len(seeds), slots)).copy()
            perm[rows, first] = 0
            perm[rows, 0] = first
        elif keep.sum() < 0.7 * len(keep):
            seeds, base, perm = seeds[keep], base[keep], perm[keep]
            rows = np.arange(len(seeds))
    return out.reshape(count, slots)


def band_keys(signatures: np.ndarray, rows: int = 4) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` slots, the band number hashed in."""
    count, slots = signatures.shape
    bands = signatures[:, : slots // rows * rows].reshape(count, slots // rows, rows)
    state = np.broadcast_to((np.arange(slots // rows, dtype=np.uint64) + np.uint64(1)) * _GOLD, bands.shape[:2])
    for i in range(rows):
        state = mix64(state + bands[:, :, i])
    return np.ascontiguousarray(state).view(np.int64)
