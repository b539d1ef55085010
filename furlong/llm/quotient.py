"""Counting quotient filters over packed n-grams of word numbers: exact, sorted, and small.

An n-gram of up to three words is three limbs of `bits` bits (0: no word). An invertible permutation of the limbs spreads
n-grams evenly and loses nothing: the first limb is then the quotient, the two others are the remainder, kept whole. A
filter is its entries in order of (quotient, remainder). The top of a quotient is not stored: one bit string has a 1 for each entry and a 0
after each slot, so an entry's slot is its place in the string less its number. What is left of the
quotient, and the remainder, take whole bytes; a counter takes one, and eight more from 255 on. Filters of
the same n-grams from anywhere can be merged, as they are sorted.
"""

from __future__ import annotations

import struct

import numpy as np

_U = np.uint64
_HEAD = struct.Struct("<QQBB")


def _mix(a, b, salt: int, bits: int):
    """A limb made of two others; it need not be invertible, as it is only added (by exclusive or) to the third."""
    x = (a * _U(0x9E3779B97F4A7C15) + b) * _U(0xD1342543DE82EF95) + _U(salt * 0x2545F4914F6CDD1D & (1 << 64) - 1)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return (x ^ (x >> _U(32))) * _U(0x94D049BB133111EB) >> _U(64 - bits)


def permute(x, y, z, bits: int):
    """Quotients and remainders of n-grams (limbs x, y, z as uint64)."""
    x = x ^ _mix(y, z, 1, bits)
    y = y ^ _mix(x, z, 2, bits)
    z = z ^ _mix(x, y, 3, bits)
    x = x ^ _mix(y, z, 4, bits)
    return x, y << _U(bits) | z


def restore(quotient, remainder, bits: int):
    """The n-grams of quotients and remainders: permute() backwards."""
    x, y, z = quotient, remainder >> _U(bits), remainder & _U((1 << bits) - 1)
    x = x ^ _mix(y, z, 4, bits)
    z = z ^ _mix(x, y, 3, bits)
    y = y ^ _mix(x, z, 2, bits)
    return x ^ _mix(y, z, 1, bits), y, z


def tally(quotient, remainder, bits: int, counts=None):
    """Distinct entries in order, with their counts (1 each where none are given) added up."""
    if not len(quotient):
        return quotient, remainder, np.zeros(0, np.int64)
    narrow = 3 * bits <= 64
    key = quotient << _U(2 * bits) | remainder if narrow else None
    if narrow and counts is None:
        key = np.sort(key)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[first] >> _U(2 * bits), key[first] & _U((1 << 2 * bits) - 1), np.diff(np.append(first, len(key)))
    # runs that are in order already, as those of filters are, are merged by the stable sort
    order = np.argsort(key, kind="stable") if narrow else np.lexsort((remainder, quotient))
    quotient, remainder = quotient[order], remainder[order]
    counts = np.ones(len(order), np.int64) if counts is None else counts[order]
    first = np.flatnonzero(np.concatenate([[True], (quotient[1:] != quotient[:-1]) | (remainder[1:] != remainder[:-1])]))
    return quotient[first], remainder[first], np.add.reduceat(counts, first)


def _bytes(values, bits: int):
    n = (bits + 7) // 8
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes(), n


def pack(quotient, remainder, counts, bits: int, low: int, width: int) -> bytes:
    """The filter of sorted entries whose quotients lie in low .. low + 2^width - 1."""
    n = len(quotient)
    cut = max(0, width - n.bit_length())
    slot, rest = (quotient - _U(low)) >> _U(cut), (quotient - _U(low)) & _U((1 << cut) - 1)
    marks = np.zeros(n + (1 << width - cut), np.uint8)
    marks[slot.astype(np.int64) + np.arange(n)] = 1
    large = counts[counts >= 255]
    return b"".join([_HEAD.pack(n, low, width, cut), np.packbits(marks).tobytes(), _bytes(rest, cut)[0], _bytes(remainder, 2 * bits)[0], np.minimum(counts, 255).astype(np.uint8).tobytes(), large.astype("<i8").tobytes()])


def unpack(blob: bytes, bits: int):
    """Quotients, remainders and counts of a filter."""
    n, low, width, cut = _HEAD.unpack_from(blob)
    at = _HEAD.size
    size = n + (1 << width - cut)

    def take(count, dtype=np.uint8):
        nonlocal at
        got = np.frombuffer(blob, dtype, count, at)
        at += got.nbytes
        return got

    def numbers(width_in_bits):
        k = (width_in_bits + 7) // 8
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :k] = take(n * k).reshape(n, k)
        return wide.view("<u8").reshape(-1).astype(_U)

    ones = np.flatnonzero(np.unpackbits(take((size + 7) // 8), count=size))
    slot = (ones - np.arange(n)).astype(_U)
    rest, remainder, counts = numbers(cut), numbers(2 * bits), take(n).astype(np.int64)
    counts[counts == 255] = take(int((counts == 255).sum()), "<i8")
    return (slot << _U(cut) | rest) + _U(low), remainder, counts


def split(quotient, remainder, counts, bits: int, parts: int):
    """(part, filter) of each of 2^parts ranges of the quotient that has entries; entries are sorted."""
    width = bits - parts
    ends = np.searchsorted(quotient, np.arange(1, (1 << parts) + 1, dtype=_U) << _U(width))
    start = 0
    for part, end in enumerate(ends.tolist()):
        if end > start:
            yield part, pack(quotient[start:end], remainder[start:end], counts[start:end], bits, part << width, width)
        start = end


def merge(blobs, bits: int):
    """Entries of all filters together, in order, with their counts added up."""
    got = [unpack(b, bits) for b in blobs]
    return tally(*(np.concatenate([g[i] for g in got]) for i in (0, 1)), bits, np.concatenate([g[2] for g in got]))
