"""Integers packed with seven bits a byte."""

from __future__ import annotations

import numpy as np


def varint(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes a value): 7 bits a byte, the lowest first; all bytes of a value but the last have the high bit."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1) << np.uint64(7 * k)
    end = np.cumsum(size)
    at = np.arange(int(size.sum())) - np.repeat(end - size, size)
    out = (np.repeat(values, size) >> (7 * at).astype(np.uint64)).astype(np.uint8) & np.uint8(0x7F)
    out[at < np.repeat(size, size) - 1] |= 0x80
    return out, size


def read_varint(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 0x80)
    start = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
    at = np.arange(len(raw)) - np.repeat(start, ends - start + 1)
    bits = (raw & 0x7F).astype(np.int64) << (7 * at)
    return np.add.reduceat(bits, start) if len(start) else np.zeros(0, np.int64)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending integers by their differences."""
    return varint(np.diff(values, prepend=0))[0].tobytes()


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(read_varint(np.frombuffer(packed, np.uint8)))
