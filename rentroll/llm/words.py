"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a longest run of ASCII letters and digits and of non-ASCII characters, with A-Z lower-cased. All functions
work on a batch whose texts lie one after the other in one buffer; ``slices`` cuts a batch so that the arrays stay
small whatever the batch size (a single text is never cut).
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FORM = np.zeros(256, np.uint8)  # the byte that stands for each byte in a word; 0 between words
for _b in range(256):
    if _b >= 0x80 or chr(_b).isalnum():
        FORM[_b] = ord(chr(_b).lower()) if _b < 0x80 else _b

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_SPAN = 1 << 21


def powers(x, n):
    out = np.full(n, x, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = powers(BASE, _SPAN)
_DOWN = powers(pow(BASE, -1, 1 << 64), _SPAN)


def mix(x):
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Words:
    """Words of a run of texts: ``start``/``end`` byte places, ``hash``, and ``first`` word of each text (n + 1)."""

    def __init__(self, data, bounds):
        form = FORM[data]
        inside = form != 0
        before = np.empty(len(data) + 1, bool)
        before[0], before[1:] = False, inside
        before[bounds] = False  # a word never goes on into the next text
        opens = inside & ~before[:-1]
        after = np.empty(len(data) + 1, bool)
        after[-1], after[:-1] = False, inside
        after[bounds] = False
        closes = inside & ~after[1:]
        self.form = form
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, bounds)
        n = len(data)
        up, down = (_UP, _DOWN) if n < _SPAN else (powers(BASE, n + 1), powers(pow(BASE, -1, 1 << 64), n + 1))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(form * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def grams(self, k):
        """Hashes of k consecutive words, by place of the first; valid where ``within(k)``."""
        n = max(0, len(self.hash) - k + 1)
        out = np.zeros(n, np.uint64)
        factor = 1
        for j in range(k):
            out += self.hash[j : j + n] * np.uint64(factor)
            factor = factor * BASE & (1 << 64) - 1
        return mix(out)

    def within(self, k):
        """Whether k words from each place on belong to the same text."""
        n = max(0, len(self.hash) - k + 1)
        last = np.repeat(self.first[1:], np.diff(self.first))[:n]
        return np.arange(n) + k <= last

    def of(self):
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, i, k=1):
        """k words from word i on, joined by a space."""
        return b" ".join(self.form[self.start[j] : self.end[j]].tobytes() for j in range(i, i + k)).decode()


def buffer_of(texts):
    """(bytes, bounds) of an Arrow string array; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def parts_of(batch, column, rows, size):
    """Runs of whole rows of about ``size`` bytes of text."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < batch.num_rows:
        before = int(sizes[row - 1]) if row else 0
        to = min(row + rows, max(row + 1, int(np.searchsorted(sizes, before + size, "right"))))
        yield batch.slice(row, to - row)
        row = to


def slices(texts, most=_SPAN - 1):
    """(from row, to row, Words) for runs of whole texts of at most ``most`` bytes, or of one longer text."""
    raw, at = buffer_of(texts)
    row, n = 0, len(at) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, to, Words(raw[at[row] : at[to]], at[row : to + 1] - at[row])
        row = to


def hash_of(phrase):
    """Word hashes of a fixed phrase."""
    return next(slices(pa.array([phrase])))[2]
