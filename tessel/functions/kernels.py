"""Numpy kernels on dense blocks.

Each problem has four roles: A updates the pivot block from itself, B the pivot row, C the pivot
column, D the rest. The iterative form loops over the pivot index and lets numpy do the plane; the
tiled form cuts a block into r x r tiles until they have at most `base` rows, for blocks that
don't fit a cache. Both give the same results, but for the order in which products are summed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


def tiles(n: int, r: int) -> list[slice]:
    size = -(-n // r)
    return [slice(a, min(a + size, n)) for a in range(0, n, size)]


@dataclass(frozen=True)
class Tiling:
    """Whether blocks are cut further, and how."""

    tiled: bool = False
    r: int = 2
    base: int = 64

    def __post_init__(self):
        if self.r < 2 or self.base < 1:
            raise ValueError("tiling needs at least 2 tiles a side and a base of 1")

    def cut(self, *sizes: int) -> bool:
        return self.tiled and max(sizes) > self.base


def minplus(x: np.ndarray, u: np.ndarray, v: np.ndarray, how: Tiling = Tiling()) -> np.ndarray:  # noqa: B008
    """x = min(x, u (x) v) in the (min, +) semiring, for rectangular blocks."""
    if how.cut(*x.shape, u.shape[1]):
        for k in tiles(u.shape[1], how.r):
            for i in tiles(x.shape[0], how.r):
                for j in tiles(x.shape[1], how.r):
                    minplus(x[i, j], u[i, k], v[k, j], how)
    else:
        through = np.empty(x.shape)
        for k in range(u.shape[1]):
            np.minimum(x, np.add(u[:, k, None], v[None, k, :], out=through), out=x)
    return x


def closure(x: np.ndarray, how: Tiling = Tiling()) -> np.ndarray:  # noqa: B008
    """Shortest paths inside one square block."""
    if how.cut(len(x)):
        parts = tiles(len(x), how.r)
        for k in parts:
            closure(x[k, k], how)
            pivot = x[k, k].copy()
            rest = [p for p in parts if p != k]
            for j in rest:
                minplus(x[k, j], pivot, x[k, j].copy(), how)
                minplus(x[j, k], x[j, k].copy(), pivot, how)
            for i in rest:
                for j in rest:
                    minplus(x[i, j], x[i, k], x[k, j], how)
    else:
        through = np.empty(x.shape)
        for k in range(len(x)):
            np.minimum(x, np.add(x[:, k, None], x[None, k, :], out=through), out=x)
    return x


def lu(x: np.ndarray, how: Tiling = Tiling()) -> np.ndarray:  # noqa: B008
    """Unpivoted factors in one block: multipliers below the diagonal, the upper factor on and above it."""
    if how.cut(len(x)):
        parts = tiles(len(x), how.r)
        for at, k in enumerate(parts):
            lu(x[k, k], how)
            for j in parts[at + 1 :]:
                solve_lower(x[k, k], x[k, j], how)
                solve_upper(x[k, k], x[j, k], how)
            for i in parts[at + 1 :]:
                for j in parts[at + 1 :]:
                    subtract(x[i, j], x[i, k], x[k, j], how)
    else:
        for k in range(len(x) - 1):
            if x[k, k] == 0:
                raise ZeroDivisionError("a pivot is zero; elimination without pivoting can't go on")
            x[k + 1 :, k] /= x[k, k]
            x[k + 1 :, k + 1 :] -= np.outer(x[k + 1 :, k], x[k, k + 1 :])
    return x


def subtract(x: np.ndarray, u: np.ndarray, v: np.ndarray, how: Tiling = Tiling()) -> np.ndarray:  # noqa: B008
    """x = x - u v, for rectangular blocks."""
    if how.cut(*x.shape, u.shape[1]):
        for k in tiles(u.shape[1], how.r):
            for i in tiles(x.shape[0], how.r):
                for j in tiles(x.shape[1], how.r):
                    subtract(x[i, j], u[i, k], v[k, j], how)
    else:
        x -= u @ v
    return x


def solve_lower(factors: np.ndarray, x: np.ndarray, how: Tiling = Tiling()) -> np.ndarray:  # noqa: B008
    """x = L^-1 x, with L's unit diagonal implied."""
    if how.cut(*factors.shape, x.shape[1]):
        parts = tiles(len(factors), how.r)
        for j in tiles(x.shape[1], how.r):
            for at, k in enumerate(parts):
                solve_lower(factors[k, k], x[k, j], how)
                for i in parts[at + 1 :]:
                    subtract(x[i, j], factors[i, k], x[k, j], how)
    else:
        for k in range(len(factors) - 1):
            x[k + 1 :] -= np.outer(factors[k + 1 :, k], x[k])
    return x


def solve_upper(factors: np.ndarray, x: np.ndarray, how: Tiling = Tiling()) -> np.ndarray:  # noqa: B008
    """x = x U^-1."""
    if how.cut(*factors.shape, len(x)):
        parts = tiles(len(factors), how.r)
        for i in tiles(len(x), how.r):
            for at, k in enumerate(parts):
                solve_upper(factors[k, k], x[i, k], how)
                for j in parts[at + 1 :]:
                    subtract(x[i, j], x[i, k], factors[k, j], how)
        return x
    for k in range(len(factors)):
        if factors[k, k] == 0:
            raise ZeroDivisionError("a pivot is zero; elimination without pivoting can't go on")
        x[:, k] /= factors[k, k]
        x[:, k + 1 :] -= np.outer(x[:, k], factors[k, k + 1 :])
    return x


#: F(row, column) for arrays of indices.
Weight = Callable[[np.ndarray, np.ndarray], np.ndarray]


def stub_weight(row: np.ndarray, column: np.ndarray) -> np.ndarray:
    return (row + column).astype(float)


def contact_weight(protein: np.ndarray) -> Weight:
    """F(j, k): contacts of a chain folded behind j, up to k: places t in j+2..min(k, 2j) that meet 2j-t-1 >= 0, both 1."""
    ones, sums = protein.astype(bool), {}

    def running(j: int) -> np.ndarray:
        if j not in sums:
            t = np.arange(j + 2, min(2 * j, len(ones)))  # 2j would meet a place before the chain
            meet = (ones[t] & ones[2 * j - t - 1]) if len(t) else np.zeros(0, dtype=bool)
            sums[j] = np.concatenate([[0], np.cumsum(meet)])
        return sums[j]

    def weight(row: np.ndarray, column: np.ndarray) -> np.ndarray:
        row, column = np.broadcast_arrays(row, column)
        out = np.zeros(row.shape)
        for j in np.unique(row):
            total, here = running(int(j)), row == j
            out[here] = total[np.clip(column[here] - j - 1, 0, len(total) - 1)]  # places j+2..column
        return out

    return weight


def fold(x: np.ndarray, i0: int, j0: int, u: np.ndarray, u0: int, k0: int, n: int, weight: Weight, how: Tiling = Tiling()) -> np.ndarray:  # noqa: B008
    """Accordion folding: cells (i, j) of x against columns k of u, in descending order.

    x holds rows from i0 and columns from j0; u holds rows j+1 from u0 on, and columns from k0.
    u may be x itself: a column is final once all k two above it have been applied.
    """
    if u is x and how.cut(x.shape[1]):
        parts = tiles(x.shape[1], how.r)
        for at in range(len(parts) - 1, -1, -1):
            k = parts[at]
            own = x[:, k]
            fold(own, i0, j0 + k.start, own, u0, k0 + k.start, n, weight, how)
            for j in parts[:at]:  # these columns are final now
                fold(x[:, j], i0, j0 + j.start, own, u0, k0 + k.start, n, weight, how)
        return x
    if u is not x and how.cut(*x.shape, u.shape[1]):
        for k in tiles(u.shape[1], how.r):
            for i in tiles(x.shape[0], how.r):
                for j in tiles(x.shape[1], how.r):
                    fold(x[i, j], i0 + i.start, j0 + j.start, u[:, k], u0, k0 + k.start, n, weight, how)
        return x
    i, j = i0 + np.arange(x.shape[0])[:, None], j0 + np.arange(x.shape[1])[None, :]
    inside = (j >= i + 1) & (j <= n - 3) & (i <= n - 4)
    at = j[0] + 1 - u0
    held = (at >= 0) & (at < u.shape[0])
    for k in range(min(n, k0 + u.shape[1]) - 1, max(3, k0) - 1, -1):
        live = inside & (j <= k - 2) & held[None, :]
        if live.any():
            from_row = np.where(held, u[np.clip(at, 0, u.shape[0] - 1), k - k0], 0.0)
            ii, jj = np.nonzero(live)
            gain = from_row[jj] + weight(jj + j0 + 1, np.minimum(k, 2 * (jj + j0) - (ii + i0) + 1))
            x[ii, jj] = np.maximum(x[ii, jj], gain)
    return x


#: w(from, to) for arrays of indices: the cost of a gap.
Gap = Callable[[np.ndarray, np.ndarray], np.ndarray]


def sum_gap(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (start + end).astype(float)


def gap_from(block: np.ndarray, first: int, columns: np.ndarray, gap: Gap) -> np.ndarray:
    """The least of block[i, q] + w(q, j) over its columns q, for each row i and each j of `columns`."""
    out = np.full((block.shape[0], len(columns)), np.inf)
    return minplus(out, block, gap(first + np.arange(block.shape[1])[:, None], columns[None, :]))


def align(best: np.ndarray, corner: float, top: np.ndarray, left: np.ndarray, i0: int, j0: int, x: str, y: str, gap: Gap) -> np.ndarray:
    """Fills a block of the alignment table in place.

    best: the least that gaps from blocks outside give; top, left, corner: the neighbours' edges
    (infinite where there are none); x[i], y[j]: characters at global places, place 0 unused.
    """
    rows, columns = best.shape
    q, p = j0 + np.arange(columns), i0 + np.arange(rows)
    for a in range(rows):
        for b in range(columns):
            i, j = i0 + a, j0 + b
            if i == 0 and j == 0:
                best[a, b] = 0.0
                continue
            value = best[a, b]
            if i and j:
                before = best[a - 1, b - 1] if a and b else corner if not a and not b else top[b - 1] if not a else left[a - 1]
                value = min(value, before + (x[i] != y[j]))
            if b:
                value = min(value, float((best[a, :b] + gap(q[:b], np.array(j))).min()))
            if a:
                value = min(value, float((best[:a, b] + gap(p[:a], np.array(i))).min()))
            best[a, b] = value
    return best
