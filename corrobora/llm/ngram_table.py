"""An open-addressed table of n-grams in numpy: xxhash64 keys, verified byte by byte; used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_FOLD = np.full(256, 32, dtype=np.uint8)
for _low, _high in ((48, 58), (97, 123), (128, 256)):
    _FOLD[_low:_high] = np.arange(_low, _high)
_FOLD[65:91] = np.arange(97, 123)

# The primes of xxhash64 and the polynomial of CRC-32.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261,
))
CRC_POLYNOMIAL = 0xEDB88320

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(CRC_POLYNOMIAL), _CRC >> 1).astype(np.uint32)


@dataclass
class Grams:
    """The n-gram occurrences of some documents: places in ``data``, where words are parted by single spaces."""

    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    doc: np.ndarray
    n_words: np.ndarray


def grams_of(column: pa.Array, longest: int = 2, most_bytes: int = 1 << 20) -> Iterator[tuple[int, Grams]]:
    """(first row, occurrences) over slices of a binary column; a slice has about ``most_bytes``, or is one text.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; occurrences are all runs of 1 to
    ``longest`` words of one text. Null is empty.
    """
    column = column.fill_null(b"") if column.null_count else column
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + most_bytes, side="right")) - 1)
        yield row, _grams(raw[ends[row] : ends[last]], np.diff(ends[row : last + 1]), longest)
        row = last


def _grams(raw: np.ndarray, sizes: np.ndarray, longest: int) -> Grams:
    n = len(sizes)
    spaced = np.full(len(raw) + n, 32, dtype=np.uint8)  # a blank after every text
    spaced[np.arange(len(raw)) + np.repeat(np.arange(n), sizes)] = _FOLD[raw]
    edge = np.diff(np.concatenate(([0], (spaced != 32).view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    word_doc = np.searchsorted(np.cumsum(sizes + 1), starts, side="right")
    inside = spaced != 32
    inside[ends] = True  # one blank after each word stays
    length = ends - starts
    at = np.cumsum(length + 1) - length - 1
    data = np.concatenate((spaced[inside], np.zeros(40, dtype=np.uint8)))
    parts = [(at, length, word_doc)]
    for k in range(1, longest):
        same = np.flatnonzero(word_doc[k:] == word_doc[:-k]) if len(at) > k else np.zeros(0, dtype=np.int64)
        parts.append((at[same], at[same + k] + length[same + k] - at[same], word_doc[same]))
    start, size, doc = (np.concatenate(c) for c in zip(*parts, strict=True))
    return Grams(data, start, size, doc, np.bincount(word_doc, minlength=n))


def _lanes(data: np.ndarray, width: int) -> np.ndarray:
    """The little-endian integer of ``width`` bytes at every place of ``data``."""
    return np.ndarray((len(data) - width + 1,), dtype=f"<u{width}", buffer=data, strides=(1,))


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxhash64(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of ``data[start : start + length]`` for all occurrences at once; ``data`` has 8 spare bytes."""
    wide, half = _lanes(data, 8), _lanes(data, 4)
    out = np.full(len(start), P5, dtype=np.uint64)
    at, left = start.copy(), length.copy()
    long = np.flatnonzero(length >= 32)
    if len(long):
        with np.errstate(over="ignore"):
            seeds = [P1 + P2, P2, np.uint64(0), np.uint64(0) - P1]
        acc = [np.full(len(long), s, dtype=np.uint64) for s in seeds]
        active = np.arange(len(long))
        while len(active):
            which = long[active]
            for i in range(4):
                acc[i][active] = _turn(acc[i][active] + wide[at[which] + 8 * i] * P2, 31) * P1
            at[which] += 32
            left[which] -= 32
            active = active[left[which] >= 32]
        joined = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
        for a in acc:
            joined = (joined ^ (_turn(a * P2, 31) * P1)) * P1 + P4
        out[long] = joined
    out += length.astype(np.uint64)
    active = np.flatnonzero(left >= 8)
    while len(active):
        lane = wide[at[active]]
        out[active] = _turn(out[active] ^ (_turn(lane * P2, 31) * P1), 27) * P1 + P4
        at[active] += 8
        left[active] -= 8
        active = active[left[active] >= 8]
    active = np.flatnonzero(left >= 4)
    out[active] = _turn(out[active] ^ (half[at[active]].astype(np.uint64) * P1), 23) * P2 + P3
    at[active] += 4
    left[active] -= 4
    active = np.flatnonzero(left > 0)
    while len(active):
        out[active] = _turn(out[active] ^ (data[at[active]].astype(np.uint64) * P5), 11) * P1
        at[active] += 1
        left[active] -= 1
        active = active[left[active] > 0]
    out = (out ^ (out >> np.uint64(33))) * P2
    out = (out ^ (out >> np.uint64(29))) * P3
    return out ^ (out >> np.uint64(32))


def crc32(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[start : start + length]`` for all occurrences at once."""
    out = np.full(len(start), 0xFFFFFFFF, dtype=np.uint32)
    active, k = np.flatnonzero(length > 0), 0
    while len(active):
        state = out[active]
        out[active] = _CRC[(state ^ data[start[active] + k]) & 255] ^ (state >> 8)
        k += 1
        active = active[length[active] > k]
    return out ^ np.uint32(0xFFFFFFFF)


def _equal(grams: Grams, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether occurrences ``one`` and ``two`` have the same bytes."""
    same = grams.length[one] == grams.length[two]
    wide, k = _lanes(grams.data, 8), 0
    active = np.flatnonzero(same)
    while len(active):
        a, b = one[active], two[active]
        spare = np.maximum(0, 8 - (grams.length[a] - k)).astype(np.uint64) * np.uint64(8)
        same[active] = ((wide[grams.start[a] + k] ^ wide[grams.start[b] + k]) << spare) == 0
        k += 8
        active = active[same[active] & (grams.length[a] > k)]
    return same


@dataclass
class Interned:
    """The distinct n-grams of some occurrences: a bucket and a count per used slot, and every occurrence's slot."""

    bucket: np.ndarray
    count: np.ndarray
    slot: np.ndarray


def intern(grams: Grams, buckets: int) -> Interned:
    """Interns the occurrences in an open-addressed table with linear probing, at most half full.

    Every occurrence goes to the place of its key. A free place is claimed by one of the occurrences that want it; those
    equal to the claimant in key and bytes share its slot, the others try the next place. CRC-32 runs once per slot.
    """
    n = len(grams.start)
    size = 1 << max(4, int(2 * n).bit_length())
    keys = xxhash64(grams.data, grams.start, grams.length)
    holder = np.full(size, -1, dtype=np.int64)
    place = (keys & np.uint64(size - 1)).astype(np.int64)
    pending = np.arange(n)
    while len(pending):
        want = place[pending]
        free = holder[want] < 0
        holder[want[free]] = pending[free]
        owner = holder[want]
        same = keys[owner] == keys[pending]
        check = np.flatnonzero(same)
        same[check] = _equal(grams, owner[check], pending[check])
        pending = pending[~same]
        place[pending] = (place[pending] + 1) & (size - 1)
    used = np.flatnonzero(holder >= 0)
    number = np.zeros(size, dtype=np.int64)
    number[used] = np.arange(len(used))
    slot, first = number[place], holder[used]
    bucket = crc32(grams.data, grams.start[first], grams.length[first]).astype(np.int64) % buckets
    return Interned(bucket, np.bincount(slot, minlength=len(used)), slot)
