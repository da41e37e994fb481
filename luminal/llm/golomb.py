"""Golomb coding of sorted hashes with a power-of-two divisor, and packed bitmaps.

The unary quotients and the fixed-width remainders are kept in two streams, so both directions are a
handful of numpy operations over the whole run."""

from __future__ import annotations

import struct

import numpy as np


def _pack(values: np.ndarray, width: int) -> bytes:
    if not width or not len(values):
        return b""
    shifts = np.arange(width - 1, -1, -1, dtype=np.uint64)
    return np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()).tobytes()


def _unpack(data: bytes, width: int, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    if width and n:
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
        for k in range(width):
            out = (out << np.uint64(1)) | bits[:, k].astype(np.uint64)
    return out


def encode(values: np.ndarray) -> bytes:
    """values: sorted distinct uint64."""
    n = len(values)
    if not n:
        return struct.pack("<IB", 0, 0)
    gaps = np.diff(values, prepend=np.uint64(0))
    gaps[0] = values[0]
    base, gaps = int(values[0]), gaps[1:]
    mean = (int(values[-1]) - base) // max(1, n - 1)
    width = max(0, min(62, (mean * 69 // 100).bit_length() - 1)) if n > 1 else 0
    quotients = (gaps >> np.uint64(width)).astype(np.int64)
    ends = np.cumsum(quotients + 1)  # a code ends with its one bit
    unary = np.zeros(int(ends[-1]) if n > 1 else 0, np.uint8)
    unary[ends - 1] = 1
    head = np.packbits(unary).tobytes()
    return struct.pack("<IBQI", n, width, base, len(head)) + head + _pack(gaps & np.uint64((1 << width) - 1), width)


def decode(data: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<IB", data)
    if not n:
        return np.zeros(0, np.uint64)
    _, _, base, size = struct.unpack_from("<IBQI", data)
    at = struct.calcsize("<IBQI")
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, at)))[: n - 1] + 1
    quotients = (np.diff(ends, prepend=0) - 1).astype(np.uint64)
    gaps = (quotients << np.uint64(width)) | _unpack(data[at + size :], width, n - 1)
    return np.concatenate([np.array([base], np.uint64), np.uint64(base) + np.cumsum(gaps, dtype=np.uint64)])
