"""Hashed word shingles of texts, many texts at a time in numpy."""

from __future__ import annotations

import numpy as np

#: Lower-cases A-Z in UTF-8 bytes.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(raw: bytes) -> np.ndarray:
    """A hash of each word [^\\x20\\x09-\\x0D]+ of lower-cased UTF-8, in order."""
    return _hashed(raw)[0]


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and where each begins, the first byte being 1."""
    data = np.frombuffer((b"\n" + raw + b"\n").translate(_LOWER), np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    lengths = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1 - starts
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    inside = np.flatnonzero(~blank)
    place = inside - np.repeat(starts, lengths)
    powers = np.full(int(lengths.max()) + 1, _ODD, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    value = _BYTE[data[inside]] * powers[place]
    return mix(np.add.reduceat(value, np.concatenate([[0], np.cumsum(lengths)[:-1]])) + lengths.astype(np.uint64)), starts


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the texts, in order, and where each text's words begin (one more than texts)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    hashes, starts = _hashed(b"\n".join(raw))
    return hashes, np.searchsorted(starts, np.cumsum([1, *(len(r) + 1 for r in raw)]))


def sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """For each text its distinct shingles of `width` words as sorted 64-bit hashes; fewer words, but not none, are one shingle."""
    words, bounds = word_hashes(texts)
    n = max(0, len(words) - width + 1)
    rolled = np.full(n, width, np.uint64)
    for j in range(width):
        rolled += words[j : j + n] * _PLACE[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(mix(np.array([sum((int(w) * int(_PLACE[j]) for j, w in enumerate(words[a:b])), b - a) & (1 << 64) - 1], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The least of each of len(seeds) hash functions over the shingles, as 32 bits."""
    least = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        x = (shingles[i : i + 1024, None] ^ seeds) * _ODD
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(least, x.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def seeds(k: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(8)).integers(0, 1 << 63, k, dtype=np.uint64)
