"""Rising numbers as bytes: the gaps between them, short ones in fewer bytes."""

from __future__ import annotations

import numpy as np


def squeeze(rising: np.ndarray) -> bytes:
    """Rising numbers as the gaps between them, seven bits a byte and the eighth for more."""
    gaps = np.diff(rising, prepend=rising.dtype.type(0))
    size = np.ones(len(gaps), np.int64)
    for k in range(1, 10):
        size += gaps >= np.uint64(1 << 7 * k)
    starts = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        more = np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
        out[starts[has] + k] = ((gaps[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out.tobytes()


def expand(raw: bytes) -> np.ndarray:
    """The numbers that ``squeeze`` has packed."""
    digits = np.frombuffer(raw, np.uint8)
    if not len(digits):
        return np.empty(0, np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], digits[:-1] < 128]))
    place = np.arange(len(digits)) - np.repeat(starts, np.diff(np.append(starts, len(digits))))
    parts = (digits & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.cumsum(np.add.reduceat(parts, starts))
