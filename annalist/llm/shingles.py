"""Word shingles of whole texts as 64-bit hashes, computed on the bytes of an Arrow string column with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_RNG = np.random.default_rng(20240607)
_BASE = int(_RNG.integers(1 << 62, 1 << 63)) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = _RNG.integers(1 << 32, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z fold into a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MULT = _RNG.integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        n = max(n, 1 << 20)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, one after another, and where each begins and the last ends; null counts as empty."""
    array = array.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in order, the index of each text's first word (one entry more than texts), where each word begins
    and ends in the bytes, the bytes, and where each text begins in them (one entry more)."""
    data, offsets = text_bytes(array)
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none, data, offsets
    token = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.concatenate(([False], token[:-1]))
    after = np.concatenate((token[1:], [False]))
    starts = np.flatnonzero(token & (~before | cut[:-1]))
    ends = np.flatnonzero(token & (~after | cut[1:])) + 1
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    hashed = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashed, np.searchsorted(starts, offsets, "left"), starts, ends, data, offsets


def words(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return word_spans(array)[:2]


def shingles(array: pa.Array, k: int):
    """For each text the sorted hashes of its distinct k-word shingles.

    A text of fewer words is one shingle; a text without words gives an empty array.
    """
    w, first = words(array)
    if len(w) >= k:
        whole = np.zeros(len(w) - k + 1, np.uint64)
        for j in range(k):
            whole += w[j : len(w) - k + 1 + j] * _MULT[j]
        whole = mix(whole)
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        if n == 0:
            yield np.zeros(0, np.uint64)
        elif n < k:
            h = np.uint64(n)
            with np.errstate(over="ignore"):
                for j in range(n):
                    h = h + w[a + j] * _MULT[j + 32]
            yield mix(np.array([h], np.uint64))
        else:
            yield np.unique(whole[a : b - k + 1])
