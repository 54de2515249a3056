"""Counting quotient filters that lose nothing: sorted, mergeable counters of packed word-id n-grams.

The ids of an n-gram are packed into one number of ``size * bits`` bits, a missing last word as 0, and permuted by
a Feistel network, so that keys spread evenly and the n-gram comes back from its key. The leading bits of a key
name its range, the next ones its quotient, the rest is its remainder. A filter of one range keeps the length of
every quotient's run in unary, the whole remainders in order, and one byte of count each, with an exact list of the
larger counts: nothing is approximate, and filters of one range merge like sorted lists.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from roadledger.llm.jaccard import mixed

ROUNDS = 4
_U = np.uint64


@dataclass(frozen=True)
class Packing:
    """Keys of up to ``size`` ids below 2**bits; ``range_bits`` leading bits name the range."""

    size: int
    bits: int
    range_bits: int

    def __post_init__(self):
        if not 0 < self.size * self.bits <= 126:
            raise ValueError(f"{self.size} ids of {self.bits} bits do not fit a key of 126 bits")
        object.__setattr__(self, "range_bits", min(self.range_bits, self.half))

    @property
    def half(self) -> int:
        return (self.size * self.bits + 1) // 2

    @property
    def mask(self) -> np.uint64:
        return _U((1 << self.half) - 1)

    def pack(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of the keys of the n-grams whose i-th words are ids[i]."""
        hi, lo = np.zeros(len(ids[0]), _U), np.zeros(len(ids[0]), _U)
        for i, x in enumerate(ids):
            x, at = x.astype(_U), (self.size - 1 - i) * self.bits
            if at < self.half:
                lo |= x << _U(at) & self.mask
                if at + self.bits > self.half:
                    hi |= x >> _U(self.half - at)
            else:
                hi |= x << _U(at - self.half)
        return self._rounds(hi, lo)

    def unpack(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The ids [key, word] of permuted keys."""
        for i in reversed(range(ROUNDS)):
            hi, lo = lo ^ self._turn(hi, i), hi
        out, one = np.zeros((len(hi), self.size), np.int64), _U((1 << self.bits) - 1)
        for i in range(self.size):
            at = (self.size - 1 - i) * self.bits
            x = lo >> _U(at) if at < self.half else hi >> _U(at - self.half)
            if at < self.half < at + self.bits:
                x |= hi << _U(self.half - at)
            out[:, i] = (x & one).astype(np.int64)
        return out

    def _turn(self, x: np.ndarray, i: int) -> np.ndarray:
        return mixed(x + _U(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1)) & self.mask

    def _rounds(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for i in range(ROUNDS):
            hi, lo = lo, hi ^ self._turn(lo, i)
        return hi, lo

    def counted(self, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order with the sum of their counts (1 each where none are given)."""
        if not len(hi):
            return hi, lo, np.zeros(0, np.int64)
        if self.half <= 32:
            x = hi << _U(self.half) | lo
            if counts is None:
                x.sort()
            else:
                order = np.argsort(x, kind="stable")  # a merge of sorted runs
                x, counts = x[order], counts[order]
            new = np.append(True, x[1:] != x[:-1])
            at = np.flatnonzero(new)
            hi, lo = x[at] >> _U(self.half), x[at] & self.mask
        else:
            order = np.lexsort((lo, hi))
            hi, lo = hi[order], lo[order]
            counts = counts if counts is None else counts[order]
            at = np.flatnonzero(np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])))
            new, hi, lo = order, hi[at], lo[at]
        return hi, lo, np.diff(np.append(at, len(new))) if counts is None else np.add.reduceat(counts, at)

    def filters(self, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray) -> list[tuple[int, bytes]]:
        """(range, filter) of every range that has one of the ordered distinct keys."""
        rest = _U(self.half - self.range_bits)
        ranges = (hi >> rest).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])) if len(hi) else np.zeros(0, np.int64)
        inner = hi & _U((1 << int(rest)) - 1)
        return [(int(ranges[a]), self._encode(inner[a:b], lo[a:b], counts[a:b])) for a, b in zip(cuts, np.append(cuts[1:], len(hi)))]

    def _encode(self, inner: np.ndarray, lo: np.ndarray, counts: np.ndarray) -> bytes:
        n, free = len(inner), self.half - self.range_bits
        slots = min(max(n.bit_length() - 1, 0), free)
        quotient = (inner >> _U(free - slots)).astype(np.int64)
        ends = np.cumsum(np.bincount(quotient, minlength=1 << slots)) + np.arange(1 << slots)
        unary = np.zeros(n + (1 << slots), np.uint8)
        unary[ends] = 1
        large = counts >= 255
        head = np.array([n, slots, int(large.sum())], "<i8").tobytes()
        return b"".join([head, np.packbits(unary).tobytes(), _low_bytes(inner & _U((1 << (free - slots)) - 1), free - slots),
                         _low_bytes(lo, self.half), np.where(large, 255, counts).astype(np.uint8).tobytes(), counts[large].astype("<i8").tobytes()])

    def decode(self, number: int, cell: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ordered distinct keys of a filter of range ``number``, and their counts."""
        n, slots, n_large = np.frombuffer(cell, "<i8", 3).tolist()
        free, at = self.half - self.range_bits, 24
        width = (n + (1 << slots) + 7) // 8
        ends = np.flatnonzero(np.unpackbits(np.frombuffer(cell, np.uint8, width, at), count=n + (1 << slots)))
        quotient = np.repeat(np.arange(1 << slots), np.diff(ends, prepend=-1) - 1).astype(_U)
        at += width
        low, at = _from_low_bytes(cell, at, n, free - slots)
        lo, at = _from_low_bytes(cell, at, n, self.half)
        counts = np.frombuffer(cell, np.uint8, n, at).astype(np.int64)
        counts[counts == 255] = np.frombuffer(cell, "<i8", n_large, at + n)
        return _U(number) << _U(free) | quotient << _U(free - slots) | low, lo, counts

    def merged(self, number: int, cells: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys of all filters of one range, in order, with the sums of their counts."""
        parts = [self.decode(number, c) for c in cells]
        return self.counted(*(np.concatenate(x) for x in zip(*parts)))


def _low_bytes(x: np.ndarray, bits: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :(bits + 7) // 8].tobytes()


def _from_low_bytes(cell: bytes, at: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    width = (bits + 7) // 8
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(cell, np.uint8, n * width, at).reshape(n, width)
    return out.view("<u8").reshape(n).astype(_U), at + n * width
