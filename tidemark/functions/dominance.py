"""Weighted dominance sums over arrays."""

from __future__ import annotations

import numpy as np


def dominance(value: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each query the weight of the points with low <= index < high and value < bound.

    A wavelet matrix over the ranks of the values: a pass over points and queries
    for each bit of a rank, so n log n altogether and no loop over rows.
    """
    order = np.sort(value)
    rank = np.searchsorted(order, value, side="left")
    below = np.searchsorted(order, bound, side="left")
    bits = max(1, int(len(value)).bit_length())
    low, high = np.minimum(low, high).astype(np.int64), high.astype(np.int64)
    total = np.zeros(len(low), weight.dtype)
    for bit in range(bits - 1, -1, -1):
        one = (rank >> bit & 1).astype(bool)
        zeros = np.concatenate(([0], np.cumsum(~one)))
        mass = np.concatenate(([0], np.cumsum(np.where(one, 0, weight))))
        up = (below >> bit & 1).astype(bool)
        total += np.where(up, mass[high] - mass[low], 0)
        split = zeros[-1]
        low, high = (np.where(up, split + (x - zeros[x]), zeros[x]) for x in (low, high))
        rank, weight = (np.concatenate((x[~one], x[one])) for x in (rank, weight))
    return total
