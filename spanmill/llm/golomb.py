"""Golomb-Rice codes of sorted numbers: gaps as unary quotients and fixed-width remainders, each in a stream of bits of its own."""

from __future__ import annotations

import numpy as np


def width_for(space: int, count: int) -> int:
    """Bits of a remainder for ``count`` numbers spread evenly over ``space``."""
    gap = space // max(1, count)
    return max(0, gap.bit_length() - 1)


def encode(numbers: np.ndarray, width: int) -> bytes:
    """Sorted unsigned 64-bit ``numbers`` as bytes; gaps count from zero."""
    gaps = np.diff(numbers, prepend=np.uint64(0))
    quotients = (gaps >> np.uint64(width)).astype(np.int64)
    stops = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(stops[-1]) + 1 if len(stops) else 0, np.uint8)
    unary[stops] = 1
    rest = (gaps[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(rest.astype(np.uint8).ravel()).tobytes() + np.packbits(unary).tobytes()


def decode(data: bytes, count: int, width: int) -> np.ndarray:
    """The ``count`` numbers that ``encode`` was given."""
    bits, head = np.frombuffer(data, np.uint8), (count * width + 7) // 8
    rest = np.unpackbits(bits[:head], count=count * width).reshape(count, width).astype(np.uint64)
    low = (rest << np.arange(width, dtype=np.uint64)).sum(1, dtype=np.uint64)
    stops = np.flatnonzero(np.unpackbits(bits[head:]))[:count]
    quotients = np.diff(stops, prepend=-1) - 1
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(width)) + low, dtype=np.uint64)
