"""Hashes of word shingles in numpy, for operators whose results don't name a hash function.

A word's bytes go into a polynomial modulo 2^64 over a table of random numbers, as differences of its running sums; A-Z have the
numbers of a-z. Words' hashes are mixed, and a shingle's is a mixed combination of those of its words. A word of more than PIECE bytes
is hashed as a string.

Defined results: words are as in golay_simhash.words; fewer words than a shingle has make one shingle, none (null text) make none.
"""

from __future__ import annotations

import numpy as np
import xxhash

PIECE = 1 << 16  #: bytes whose sums are taken at a time, so that arrays stay in the cache
_FACTOR = 0x9E3779B97F4A7C15
_NUMBERS = np.array([xxhash.xxh64_intdigest(bytes([c]).lower(), 11) for c in range(256)], np.uint64)
_SOLID = np.array([c != 0x20 and not 0x09 <= c <= 0x0D for c in range(256)])
_POWERS, _INVERSES = (np.cumprod(np.array([1] + [f] * PIECE, np.uint64), dtype=np.uint64) for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64)))
_PLACES = np.array([xxhash.xxh64_intdigest(str(i), 13) | 1 for i in range(64)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts, and its hash."""
    b = np.frombuffer(data, np.uint8)
    solid = np.zeros(len(b) + 2, bool)
    solid[1:-1] = _SOLID[b]
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, stops = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = int(np.searchsorted(stops, at + PIECE, side="right"))
        if i == j:
            out[i] = xxhash.xxh64_intdigest(data[at : int(stops[i])].lower(), 17)
            i += 1
            continue
        n = int(stops[j - 1]) - at
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_NUMBERS[b[at : at + n]] * _POWERS[:n], out=total[1:])
        first = starts[i:j] - at
        out[i:j] = (total[stops[i:j] - at] - total[first]) * _INVERSES[first]
        i = j
    return starts, _mix(out)


def _combined(w: np.ndarray, size: int) -> np.ndarray:
    n = len(w) - size + 1
    total = np.zeros(max(n, 0), np.uint64)
    for i in range(size):
        total += w[i : i + len(total)] * _PLACES[i]
    return _mix(total)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """The hashes of the text's shingles of size words (64 at most), repeats included."""
    return hashes_of_each([text], size)[0]


def hashes_of_each(texts: list[str | None], size: int) -> list[np.ndarray]:
    """shingle_hashes of each text; short texts are hashed together."""
    out, held, n = [], [], 0
    for text in texts:
        held.append((text or "").encode())
        n += len(held[-1])
        if n >= PIECE:
            out += _hashed(held, size)
            held, n = [], 0
    return out + _hashed(held, size) if held else out


def _hashed(data: list[bytes], size: int) -> list[np.ndarray]:
    starts, w = _words(b"\n".join(data))
    ends = np.cumsum([len(x) + 1 for x in data])
    stops = np.searchsorted(starts, ends).tolist()
    every = _combined(w, size)
    out, a = [], 0
    for b in stops:
        out.append(every[a : b - size + 1] if b - a >= size else _combined(w[a:b], b - a) if b > a else w[:0])
        a = b
    return out
