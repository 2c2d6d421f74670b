"""Static binary-fuse filters (3 places per key, 8-bit fingerprints) over distinct 64-bit keys.

Layout and sizes follow the published construction (Graf and Lemire, 2022): segments of a power of two places, three
neighbouring segments per key. About 9 bits per key, no false negatives, about 1 in 256 false positives.
"""

import math
import struct

import numpy as np

HEADER = struct.Struct("<QIII")  # seed, segment length, segments with a first place, number of places
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(keys, seed):
    """64-bit hashes of keys; a bijection for every seed, so distinct keys stay distinct."""
    x = keys.astype(np.uint64) + np.uint64(seed)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def places(h, length, firsts):
    """The three places of each hash, as an (n, 3) array."""
    first = ((h >> np.uint64(32)) * np.uint64(firsts * length) >> np.uint64(32)).astype(np.int64)
    low = np.int64(length - 1)
    second = (first + length) ^ ((h >> np.uint64(18)).astype(np.int64) & low)
    third = (first + 2 * length) ^ (h.astype(np.int64) & low)
    return np.stack([first, second, third], axis=1)


def fingerprint(h):
    return (h ^ (h >> np.uint64(32))).astype(np.uint8)


def shape(n):
    length = 1 << max(2, min(18, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    firsts = max(1, -(-int(n * factor) // length) - 2)
    return length, firsts


def peeled(at, size):
    """Layers (keys, places): in each, every key is alone on its place once all earlier layers are gone."""
    n = len(at)
    degree = np.bincount(at.ravel(), minlength=size)
    left = np.zeros(size, np.int64)
    for j in range(3):
        np.bitwise_xor.at(left, at[:, j], np.arange(n))
    layers, gone = [], 0
    alone = np.flatnonzero(degree == 1)
    while alone.size:
        keys, which = np.unique(left[alone], return_index=True)
        layers.append((keys, alone[which]))
        gone += len(keys)
        touched = at[keys]
        for j in range(3):
            np.subtract.at(degree, touched[:, j], 1)
            np.bitwise_xor.at(left, touched[:, j], keys)
        near = np.unique(touched)
        alone = near[degree[near] == 1]
    return layers if gone == n else None


def build(keys, tries=100):
    """The filter of distinct keys as bytes."""
    keys = np.unique(np.asarray(keys, np.uint64))
    length, firsts = shape(len(keys))
    size = (firsts + 2) * length
    for seed in range(1, tries):
        h = mixed(keys, seed * 0x9E3779B97F4A7C15 & int(MASK))
        at = places(h, length, firsts)
        layers = peeled(at, size)
        if layers is not None:
            break
    else:
        raise RuntimeError(f"no seed of {tries} peels {len(keys)} keys")
    cells = np.zeros(size, np.uint8)
    wanted = fingerprint(h)
    for members, own in reversed(layers):
        cells[own] = wanted[members] ^ np.bitwise_xor.reduce(cells[at[members]], axis=1)
    return HEADER.pack(seed * 0x9E3779B97F4A7C15 & int(MASK), length, firsts, size) + cells.tobytes()


def contains(blob, keys):
    """Whether each key may be among the filter's keys (never false for one that is)."""
    seed, length, firsts, size = HEADER.unpack_from(blob)
    cells = np.frombuffer(blob, np.uint8, size, HEADER.size)
    h = mixed(np.asarray(keys, np.uint64), seed)
    return np.bitwise_xor.reduce(cells[places(h, length, firsts)], axis=1) == fingerprint(h)
