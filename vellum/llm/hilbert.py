"""Hilbert order of points on an integer grid."""

from __future__ import annotations

import numpy as np


def hilbert_key(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of non-negative ints below 2**bits; dims * bits <= 62.

    Works on all rows at once: from the highest bit down, the axes of each sub-cube are reflected or
    exchanged into the curve's frame, then the Gray code of the frame's bits is undone.
    """
    x = grid.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << b), (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key
