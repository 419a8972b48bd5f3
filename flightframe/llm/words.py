"""Vectorised word hashing over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes of words: all but white space (0x20, 0x09 to 0x0D).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of bare words: ASCII letters and digits, and every byte of other characters.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: A-Z in lower case, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SAME = np.arange(256, dtype=np.uint8)

BASE = 0x9E3779B97F4A7C15 | 1
#: Words go through the vectorised hash up to so many bytes; longer ones are hashed one by one.
LANE, LONGEST = 8, 64
_LANE_MASKS = np.array([(1 << 8 * k) - 1 for k in range(LANE + 1)], np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Words whose prefix sums are taken at once, and so the size of the tables of powers.
BLOCK = 1 << 16


def powers(base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base ** k and base ** -k modulo 2 ** 64 for k up to 2 * BLOCK; base is odd."""
    if base not in _powers:
        both = []
        for x in (base, pow(base, -1, 1 << 64)):
            factors = np.full(2 * BLOCK + 1, x, np.uint64)
            factors[0] = 1
            both.append(np.multiply.accumulate(factors))
        _powers[base] = tuple(both)
    return _powers[base]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of SplitMix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_bounds(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in data, and the n + 1 bounds of each text's words; no word crosses a text's end."""
    inside = np.append(kind[data], False)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    last = np.zeros(len(inside) + 1, bool)
    last[1:-1] = inside[:-1] & ~inside[1:]
    ends_at = offsets[1:][offsets[1:] > 0]
    last[ends_at] |= inside[ends_at - 1]
    return starts, np.flatnonzero(last), np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]], fold: np.ndarray = SAME) -> list[np.ndarray]:
    """A 64-bit hash of the bytes of each span (starts, ends): 8 bytes at a time, each mixed into the hash so far.

    Equal bytes have equal hashes; spans of one length up to 8 bytes never share one.
    """
    padded = np.zeros(len(data) + LANE, np.uint8)
    padded[: len(data)] = data if fold is SAME else fold[data]
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = []
    for starts, ends in spans:
        size = ends - starts
        h = mix(mix(size.astype(np.uint64) + np.uint64(BASE)) ^ (lanes[starts] & _LANE_MASKS[np.minimum(size, LANE)]))
        more = np.flatnonzero(size > LANE)
        for done in range(LANE, LONGEST, LANE):
            if not len(more):
                break
            part = lanes[starts[more] + done] & _LANE_MASKS[np.minimum(size[more] - done, LANE)]
            h[more] = mix(h[more] ^ part)
            more = more[size[more] > done + LANE]
        for k in more.tolist():
            h[k] = xxhash.xxh64_intdigest(padded[starts[k] : ends[k]].data, int(size[k]))
        out.append(h)
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE, fold: np.ndarray = SAME) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word's bytes, and the bounds of each text's words."""
    starts, ends, bounds = word_bounds(data, offsets, kind)
    return span_hashes(data, [(starts, ends)], fold)[0], bounds


def gram_hashes(words: np.ndarray, bounds: np.ndarray, n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words (at most BLOCK) from each position on, and whether they lie in one text.

    A polynomial by prefix sums modulo 2 ** 64, mixed; the sums start anew with each block of positions.
    """
    size = max(0, len(words) - n + 1)
    up, down = powers(base)
    grams = np.empty(size, np.uint64)
    for at in range(0, size, BLOCK):
        count = min(BLOCK, size - at)
        part = words[at : at + count + n - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        grams[at : at + count] = mix((sums[n:] - sums[: len(sums) - n]) * down[:count])
    left = np.repeat(bounds[1:], np.diff(bounds))[:size] - np.arange(size)
    return grams, left >= n
