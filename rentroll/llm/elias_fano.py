"""Elias-Fano coding of non-decreasing integers, with select.

n values below ``universe`` take about 2 + log2(universe / n) bits each: the low bits packed side by side, the high bits
as a unary bit string in which value i is the i-th one. A sample of every 64th one's place (32 bits) makes ``select`` a
short scan; no table holds a full offset per value.
"""

import struct

import numpy as np

HEADER = struct.Struct("<QQBI")  # number of values, universe, low bits, bytes of the unary part
EVERY = 64
ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def encode(values, universe):
    """Bytes of non-decreasing ``values``, each at least 0 and at most ``universe``."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    low = max(0, (int(universe) // n).bit_length() - 1) if n else 0
    places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros((int(universe) >> low) + n + 1, np.uint8)
    bits[places] = 1
    unary = np.packbits(bits, bitorder="little")
    digits = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(digits.ravel(), bitorder="little")
    samples = places[::EVERY].astype("<u4")
    return HEADER.pack(n, int(universe), low, len(unary)) + unary.tobytes() + samples.tobytes() + packed.tobytes()


class Reader:
    """Random access to an encoded sequence that starts at ``at`` in ``blob``."""

    def __init__(self, blob, at=0):
        self.n, self.universe, self.low, size = HEADER.unpack_from(blob, at)
        at += HEADER.size
        self.unary = np.frombuffer(blob, np.uint8, size, at)
        at += size
        self.samples = np.frombuffer(blob, "<u4", -(-self.n // EVERY), at)
        at += self.samples.nbytes
        self.packed = np.frombuffer(blob, np.uint8, -(-self.n * self.low // 8), at)
        self.end = at + self.packed.nbytes

    def __len__(self):
        return self.n

    def select(self, i):
        """Value i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // EVERY])
        left = i % EVERY
        byte = place // 8
        here = int(self.unary[byte]) >> place % 8 << place % 8
        while left >= ONES[here]:
            left -= int(ONES[here])
            byte += 1
            here = int(self.unary[byte])
        for _ in range(left):
            here &= here - 1
        place = byte * 8 + (here & -here).bit_length() - 1
        first, value = i * self.low, 0
        for b in range(self.low):
            value |= (int(self.packed[(first + b) // 8]) >> (first + b) % 8 & 1) << b
        return (place - i) << self.low | value

    def all(self):
        """Every value, as an array."""
        places = np.flatnonzero(np.unpackbits(self.unary, bitorder="little"))[: self.n]
        high = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)
        if not self.low:
            return high
        digits = np.unpackbits(self.packed, count=self.n * self.low, bitorder="little").reshape(self.n, self.low)
        return high | (digits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
