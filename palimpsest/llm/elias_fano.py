"""Elias-Fano coding of non-decreasing integers, with select.

The low bits of each value are packed side by side; the high parts are a bit vector in which the i-th one stands at
high(i) + i. The place of every 256th one is kept as a hint, so that select(i) looks at a few bytes only.

Defined results: values are non-negative and do not decrease; repeated values are kept; no values give a code of the head
alone; places of more than 2^32 bits are not coded (a shard has far fewer values) but refused.
"""

from __future__ import annotations

import struct

import numpy as np

HINT = 256
_HEAD = struct.Struct("<QQB")


class EliasFano:
    """Reads what ``encode`` wrote. Space: 2 + log2(universe / n) bits a value, and 32 bits for each 256 values."""

    def __init__(self, data: bytes):
        self.n, universe, self.low_bits = _HEAD.unpack_from(data)
        low = (self.n * self.low_bits + 7) // 8
        high = (self.n + (universe >> self.low_bits) + 8) // 8
        at = _HEAD.size
        self.low = np.frombuffer(data, np.uint8, low, at)
        self.high = np.frombuffer(data, np.uint8, high, at + low)
        self.hints = np.frombuffer(data, "<u4", (self.n + HINT - 1) // HINT, at + low + high)

    @staticmethod
    def encode(values) -> bytes:
        v = np.asarray(values, dtype=np.uint64)
        n, universe = len(v), int(v[-1]) if len(v) else 0
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((n + (universe >> low_bits) + 8) // 8 * 8, np.uint8)
        bits[ones] = 1
        low = np.zeros((n, low_bits), np.uint8)
        for k in range(low_bits):
            low[:, k] = (v >> np.uint64(k)) & np.uint64(1)
        if len(ones) and int(ones[-1]) >= 1 << 32:
            raise OverflowError("too many values for hints of 32 bits")
        parts = [np.packbits(x.ravel(), bitorder="little").tobytes() for x in (low, bits)]
        return _HEAD.pack(n, universe, low_bits) + b"".join(parts) + ones[::HINT].astype("<u4").tobytes()

    def select(self, i: int) -> int:
        """The i-th value, without decoding the others."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.hints[i // HINT]), i % HINT
        byte = at // 8
        word = int(self.high[byte]) & (0xFF << at % 8)
        while (ones := word.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        first, last = i * self.low_bits, (i + 1) * self.low_bits
        low = int.from_bytes(self.low[first // 8 : (last + 7) // 8].tobytes(), "little") >> first % 8
        return (one - i) << self.low_bits | low & ((1 << self.low_bits) - 1)

    def values(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Values ``first`` to ``last`` - 1, decoded from the hint before them to the one after them."""
        last = self.n if last is None else min(last, self.n)
        if first >= last:
            return np.zeros(0, np.int64)
        hint, after = first // HINT, -(-last // HINT)
        start = int(self.hints[hint])
        end = int(self.hints[after]) // 8 + 1 if after < len(self.hints) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[start // 8 : end], bitorder="little")) + start // 8 * 8
        ones = ones[ones >= start][first - hint * HINT :][: last - first]
        out = (ones - np.arange(first, last)) << self.low_bits
        at = first * self.low_bits
        bits = np.unpackbits(self.low[at // 8 : (last * self.low_bits + 7) // 8], bitorder="little")[at % 8 :][: (last - first) * self.low_bits]
        low = bits.reshape(last - first, self.low_bits)
        for k in range(self.low_bits):
            out |= low[:, k].astype(np.int64) << k
        return out
