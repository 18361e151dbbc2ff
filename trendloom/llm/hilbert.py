"""Hilbert curve index of points with whole-number coordinates (Skilling, 2004), on NumPy columns."""

from __future__ import annotations

import numpy as np


def hilbert_index(cells: list[np.ndarray], bits: int) -> np.ndarray:
    """Place along the curve of points whose coordinates lie in [0, 2**bits); one array per dimension."""
    if len(cells) * bits > 63:
        raise ValueError("the index must fit into 63 bits")
    x = [np.asarray(c).astype(np.int64) for c in cells]
    if not x or not len(x[0]):
        return np.zeros(0 if not x else len(x[0]), np.int64)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for k in range(len(x)):
            is_set = (x[k] & q) != 0
            swap = np.where(is_set, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(is_set, x[0] ^ low, x[0]) ^ swap
            x[k] = x[k] ^ swap if k else x[0]
        q >>= 1
    for k in range(1, len(x)):
        x[k] = x[k] ^ x[k - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    out = np.zeros_like(flip)
    for bit in range(bits - 1, -1, -1):
        for c in x:
            out = (out << 1) | (((c ^ flip) >> bit) & 1)
    return out
