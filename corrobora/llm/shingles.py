"""Word and shingle hashing of whole texts with numpy; used inside tasks."""

from __future__ import annotations

import hashlib

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of the splitmix generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 14), base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def _block_hashes(block: np.ndarray) -> np.ndarray:
    edge = np.diff(np.concatenate(([0], (~_SPACE[block]).view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _power(len(block))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((_LOWER[block].astype(np.uint64) + np.uint64(1)) * up)))
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(data: bytes | None) -> np.ndarray:
    """A 64-bit hash of every word ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text with A-Z lower-cased, in order.

    Long texts are hashed in blocks that end at white space, so memory is bounded by the longest word and the result.
    """
    text = np.frombuffer(data or b"", dtype=np.uint8)
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + _BLOCK)
        while end < len(text) and not _SPACE[text[end]]:
            gaps = np.flatnonzero(_SPACE[text[end : end + _BLOCK]])
            end = end + int(gaps[0]) if len(gaps) else min(len(text), end + _BLOCK)
        parts.append(_block_hashes(text[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def shingle_set(data: bytes | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of all ``words``-word shingles; a shorter text is one shingle, an empty one has none."""
    hashes = word_hashes(data)
    if not len(hashes):
        return hashes
    size = min(words, len(hashes))
    out = np.full(len(hashes) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(_BASE) + hashes[i : len(hashes) - size + 1 + i])
    return np.unique(out)


def fingerprint(hashes: np.ndarray) -> bytes:
    """128 bits that identify a sorted set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


class OnePermutation:
    """One-permutation minhash with optimal densification.

    The top bits of a hash choose its bin and the smallest hash of a bin is its minimum: one pass over the set fills all
    bins. An empty bin borrows from the first full bin of its own fixed random order over all bins, which keeps the
    collision probability of every position at the Jaccard similarity.
    """

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        if self.bins & (self.bins - 1):
            raise ValueError("bands * rows must be a power of two")
        grid = np.arange(self.bins, dtype=np.uint64)
        self.edges = grid << np.uint64(64 - self.bins.bit_length() + 1) if self.bins > 1 else grid
        draws = mix(mix(grid[:, None] + np.uint64(1)) + grid[None, :] * np.uint64(_BASE))
        self.probes = np.ascontiguousarray(np.argsort(draws, axis=1).T)
        self.odd = mix(np.arange(rows, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
        self.salt = mix(np.arange(bands, dtype=np.uint64) + np.uint64(1234567))

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        first = np.searchsorted(hashes, self.edges)
        full = first < np.append(first[1:], len(hashes))
        source = np.arange(self.bins)
        left = np.flatnonzero(~full)
        for order in self.probes:
            if not len(left):
                break
            borrowed = order[left]
            hit = full[borrowed]
            source[left[hit]] = borrowed[hit]
            left = left[~hit]
        return hashes[first[source]]

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """One bucket key per band, as signed 64-bit numbers; ``hashes`` must not be empty."""
        grid = self.minima(hashes).reshape(self.bands, self.rows)
        return mix((grid * self.odd).sum(axis=1, dtype=np.uint64) ^ self.salt).view(np.int64)
