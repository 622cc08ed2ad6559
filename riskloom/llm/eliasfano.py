"""Elias-Fano sequences of non-decreasing integers over numpy arrays (which may be memory-mapped).

A value is split into `low` bits, packed side by side, and a high part, written in unary: value i sets bit
(high part + i). Access finds the i-th set bit through the number of set bits before each 64-bit word.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_ONES, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)
#: place of the r-th set bit of a byte
_SELECT8 = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _r, _p in enumerate([p for p in range(8) if _b >> p & 1]):
        _SELECT8[_b, _r] = _p


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    v = np.asarray(values, _U)
    n = len(v)
    top = int(v[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    high = (v >> _U(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros((int(high[-1]) // 64 + 1) * 64 if n else 64, np.uint8)
    bits[high] = 1
    words = np.packbits(bits, bitorder="little").view(_U)
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(np.uint32)
    packed = np.zeros(n * low // 64 + 2, _U)
    if low:
        part = v & _U((1 << low) - 1)
        at = np.arange(n, dtype=_U) * _U(low)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        packed[word[first]] = np.bitwise_or.reduceat(part << shift, first)
        over = np.flatnonzero(shift + _U(low) > _U(64))
        packed[word[over] + 1] |= part[over] >> (_U(64) - shift[over])
    return {"meta": np.array([n, low], np.int64), "high": words, "before": before, "low": packed}


class Sequence:
    def __init__(self, parts: dict[str, np.ndarray], prefix: str = ""):
        self.n, self.low = (int(x) for x in parts[prefix + "meta"])
        self.high, self.before, self.packed = (parts[prefix + k] for k in ("high", "before", "low"))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), _U)
        at = i.astype(_U) * _U(self.low)
        w, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        part = self.packed[w] >> shift
        over = np.flatnonzero(shift + _U(self.low) > _U(64))
        if len(over):
            part[over] |= self.packed[w[over] + 1] << (_U(64) - shift[over])
        return part & _U((1 << self.low) - 1)

    @staticmethod
    def _select(bits: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Place of the rest-th set bit of each word: sums of the bytes before tell its byte, a table the rest."""
        sums = bits - (bits >> _U(1) & _U(0x5555555555555555))
        sums = (sums & _U(0x3333333333333333)) + (sums >> _U(2) & _U(0x3333333333333333))
        sums = (sums + (sums >> _U(4)) & _U(0x0F0F0F0F0F0F0F0F)) * _ONES
        rest = rest.astype(_U)
        byte = np.bitwise_count((rest * _ONES | _TOPS) - sums & _TOPS).astype(_U) << _U(3)
        rest -= (sums << _U(8)) >> byte & _U(255)
        return (byte + _SELECT8[bits >> byte & _U(255), rest]).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.before, i, "right") - 1
        high = (word << 6) + self._select(self.high[word], i - self.before[word]) - i
        return high.astype(_U) << _U(self.low) | self._low(i)

    def _below(self, high: np.ndarray, zeros: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of values with a smaller high part, and that place in high: the (high - 1)-th unset bit tells it.
        zeros: unset bits before each word."""
        nth = np.maximum(high - 1, 0)
        word = np.searchsorted(zeros, nth, "right") - 1
        past = word >= len(self.high)
        word = np.minimum(word, len(self.high) - 1)
        place = (word << 6) + self._select(~self.high[word], np.where(past, 0, nth - zeros[word]))
        return np.where(high <= 0, 0, np.where(past, self.n, place - high + 1)), np.where(high <= 0, -1, np.where(past, len(self.high) << 6, place))

    def _group(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From where on and up to where values have that high part: they are a run of set bits."""
        zeros = np.arange(len(self.before), dtype=np.int64) * 64 - self.before
        start, place = self._below(high, zeros)
        word = (place + 1) >> 6
        rest = ~self.high[np.minimum(word, len(self.high) - 1)] >> ((place + 1) & 63).astype(_U)
        end = start + np.bitwise_count((rest & -rest) - _U(1))
        far = np.flatnonzero((rest == 0) | (word >= len(self.high)))  # the run goes on in the next word
        end[far] = self._below(high[far] + 1, zeros)[0]
        return start, end

    def successor(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it holds value) of the first of places lo..hi-1 with at least value; hi if none has.

        Values with value's high part lie between two unset bits; among those few, low parts are searched."""
        high = (value >> _U(self.low)).astype(np.int64)
        want = value & _U((1 << self.low) - 1)
        end = hi.astype(np.int64)
        start, behind = self._group(high)
        a = np.minimum(np.maximum(lo, start), end)
        b = np.maximum(a, np.minimum(end, behind))
        stop = b.copy()
        live = np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) >> 1
            less = self._low(mid) < want[live]
            a[live[less]] = mid[less] + 1
            b[live[~less]] = mid[~less]
            live = live[a[live] < b[live]]
        hit = np.zeros(len(a), bool)
        inside = np.flatnonzero(a < stop)
        if len(inside):
            hit[inside] = self._low(a[inside]) == want[inside]
        return a, hit
