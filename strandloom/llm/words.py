"""Words and their hashes for whole Arrow batches, without a Python object for each word.

A word is a maximal run of bytes outside [\\x20\\x09-\\x0D]. Texts are taken from the Arrow buffers as bytes; a word's
64-bit hash is a polynomial over its bytes, read off prefix sums, so the cost is a few numpy passes over the bytes. Modulo
2^64 some words of 1,024 bytes and more have equal polynomials for every base, so words above LONG bytes get a BLAKE2 digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEED = 0x5EED
#: Odd bases of two independent polynomials.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
SLICE_BYTES = 1 << 18
LONG = 255


class Words(NamedTuple):
    """Words of some texts: text i has words offsets[i]:offsets[i+1]; word j is data[starts[j]:ends[j]]."""

    hashes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), applied to each element."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=4)
def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    base = _BASES[which]
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of a base and of its inverse, n of each at least."""
    size = SLICE_BYTES * 2
    while size < n:
        size *= 2
    return _powers(size, which)


@lru_cache(maxsize=4)
def _byte_values(lower: bool, which: int) -> np.ndarray:
    values = np.random.default_rng(_SEED + which).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    return values


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts with at most `most` bytes together, or a single longer text."""
    first, total = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += int(n)
    if len(texts) > first:
        yield first, len(texts)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes in one array (null: none) and their n+1 offsets."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words_of(texts: pa.Array, lower: bool = False, which: int = 0) -> Words:
    """Words of each text; lower: A-Z count as a-z; which: one of two independent hashes of words."""
    data, at = bytes_of(texts)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), none, none, data)
    inside = ~_IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:n]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = powers(n, which)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_byte_values(lower, which)[data] * up[:n], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    for k in np.flatnonzero(ends - starts > LONG).tolist():
        word = data[starts[k] : ends[k]].tobytes()
        digest = hashlib.blake2b(word.lower() if lower else word, digest_size=8, salt=bytes([which])).digest()
        hashes[k] = int.from_bytes(digest, "little")
    return Words(hashes, np.searchsorted(starts, at), starts, ends, data)


def window_hashes(hashes: np.ndarray, k: int, salt: int = 0, which: int = 0) -> np.ndarray:
    """Hash of each k consecutive words, wherever they lie; shorter input gives none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(hashes) + 1, which)
    sums = np.empty(len(hashes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mixed((sums[k:] - sums[:n]) * down[:n] + np.uint64(salt))


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingles as hashes; fewer than k words: the whole sequence as one."""
    all_windows, out = window_hashes(words.hashes, k, k), []
    for first, end in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist()):
        n = end - first
        if n >= k:
            out.append(np.unique(all_windows[first : end - k + 1]))
        elif n:
            out.append(window_hashes(words.hashes[first:end], n, n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
