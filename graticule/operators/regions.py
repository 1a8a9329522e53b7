"""Connected regions and sliding medians inside maps, for a whole Arrow batch at once; nothing leaves the row."""
from __future__ import annotations

import numpy as np

WINDOW_CELLS = 1 << 22  # cells of sliding windows held at once


def runs(masks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(map, row, first column, last column) of every maximal run of true cells, in order."""
    out = []
    for k, m in enumerate(masks):
        edge = np.diff(np.pad(m, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(edge == 1)
        out.append((np.full(len(row), k), row, first, np.nonzero(edge == -1)[1] - 1))
    return tuple(np.concatenate(c) if c else np.empty(0, np.int64) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 4


def _united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of every set after uniting the pairs (a, b): hooking and pointer jumping on arrays."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        a, b = a[open_], b[open_]


def regions(masks: list[np.ndarray], diagonal: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(map, cell, region, run length): true cells in order with the smallest cell of their region.

    Two passes over runs: runs of neighbouring rows that touch are united, then cells take the region of their run.
    """
    which, row, first, last = runs(masks)
    n = len(which)
    if not n:
        return (np.empty(0, np.int64),) * 3
    wide = max(m.shape[1] for m in masks) + 3
    line = which * (max(m.shape[0] for m in masks) + 1) + row  # an unused row separates maps
    reach = 1 if diagonal else 0
    # runs of the next row that end at or behind my start and start at or before my end
    lo = np.searchsorted(line * wide + last, (line + 1) * wide + first - reach)
    hi = np.searchsorted(line * wide + first, (line + 1) * wide + last + reach, side="right")
    count = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(n), count)
    b = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    root = _united(n, a, b)
    cols = np.array([m.shape[1] for m in masks])[which]
    size = last - first + 1
    of = np.repeat(np.arange(n), size)
    cell = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(row * cols + first, size)
    return which[of], cell, (row * cols + first)[root][of]


def sliding_median(z: np.ndarray, radius: int) -> np.ndarray:
    """Median of the (2 r + 1)^2 window around each cell, edges repeated outwards; by partition on a strided view."""
    side = 2 * radius + 1
    view = np.lib.stride_tricks.sliding_window_view(np.pad(z, radius, mode="edge"), (side, side))
    out, step = np.empty(z.shape), max(WINDOW_CELLS // (z.shape[1] * side * side), 1)
    for r in range(0, len(z), step):
        part = view[r: r + step].reshape(-1, side * side)
        out[r: r + step] = np.partition(part, side * side // 2, axis=1)[:, side * side // 2].reshape(-1, z.shape[1])
    return out
