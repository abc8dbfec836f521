"""Words and word shingles of many texts at once, as 64-bit hashes.

A word is a longest run of bytes outside 0x20 and 0x09-0x0D; A-Z count as a-z. A word's hash is a polynomial
of its bytes modulo 2**64, taken from running sums over the whole buffer, then mixed; so no Python object is
made per word. Texts come as one byte buffer with offsets (``common.text_bytes``).
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_CHUNK = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACES = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _CHUNK + 1)
        _powers[:] = [np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size, b)))) for b in (_BASE, _BASE_INVERSE)]
    return _powers


def word_spans(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every word in the buffer, and the number of words before each text (length texts + 1)."""
    word = ~_SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[ends] = True
    before = np.empty(len(raw), bool)
    if len(raw):
        before[0] = False
        before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | first[:-1]))
    after = np.empty(len(raw), bool)
    if len(raw):
        after[-1] = False
        after[:-1] = word[1:]
    stops = np.flatnonzero(word & (~after | first[1:])) + 1
    return starts, stops, np.searchsorted(starts, ends)


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words before each text); long buffers go chunk by chunk between words."""
    starts, stops, counts = word_spans(raw, ends)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        upto = max(int(np.searchsorted(stops, low + _CHUNK, side="right")), at + 1)
        high = stops[upto - 1]
        power, inverse = _power_tables(int(high - low))
        run = np.cumsum(_VALUE[raw[low:high]] * power[: high - low])
        s, e = starts[at:upto] - low, stops[at:upto] - low
        value = run[e - 1]
        value[s > 0] -= run[s[s > 0] - 1]
        out[at:upto] = mix(value * inverse[s])
        at = upto
    return out, counts


def shingle_sets(raw: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its 5-word shingles; with 1-4 words the whole sequence is one."""
    hashes, counts = word_hashes(raw, ends)
    n = len(hashes)
    if n >= SHINGLE:
        rolled = np.zeros(n - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            rolled += hashes[k : n - SHINGLE + 1 + k] * _PLACES[k]
        rolled = mix(rolled)
    out = []
    for a, b in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            s = rolled[a : b - SHINGLE + 1].copy()
            s.sort()
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            part = hashes[a:b] * _PLACES[: b - a]
            out.append(mix(np.array([part.sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
