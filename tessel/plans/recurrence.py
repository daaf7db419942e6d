"""The recurrences, each as a pivot order, roles of blocks, operands of roles, and kernels.

One loop runs them all: at pivot k, block A is updated from itself, blocks B and C from A, blocks D
from the B and C that share their row or column; all other blocks are finished or untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessel.functions.grid import Grid
from tessel.functions.kernels import Tiling, Weight, closure, fold, lu, minplus, solve_lower, solve_upper, subtract


@dataclass(frozen=True)
class Recurrence:
    """Roles are predicates over bi and bj; kernels take (bi, bj, x, operands...)."""

    name: str
    missing: float
    diagonal: float | None
    upper: bool
    descending: bool
    roles: Callable[[int], dict[str, Column]]
    kernels: Callable[[Grid, int], dict[str, Callable[..., np.ndarray]]]
    #: D takes its operands from the pivot's row and column, or (folding) both from the pivot's column.
    folds: bool = False

    def pivots(self, grid: Grid) -> Iterable[int]:
        return range(grid.r - 1, -1, -1) if self.descending else range(grid.r)



def shortest_paths(how: Tiling = Tiling()) -> Recurrence:  # noqa: B008
    """All-pairs shortest paths: D[i][j] = min(D[i][j], D[i][k] + D[k][j])."""

    def roles(k: int) -> dict[str, Column]:
        i, j = F.col("bi"), F.col("bj")
        return {"A": (i == k) & (j == k), "B": (i == k) & (j != k), "C": (i != k) & (j == k), "D": (i != k) & (j != k)}

    def kernels(grid: Grid, k: int) -> dict:
        return {
            "A": lambda bi, bj, x: closure(x, how),
            "B": lambda bi, bj, x, a: minplus(x, a, x.copy(), how),
            "C": lambda bi, bj, x, a: minplus(x, x.copy(), a, how),
            "D": lambda bi, bj, x, u, v: minplus(x, u, v, how),
        }

    return Recurrence("fw", np.inf, 0.0, False, False, roles, kernels)


def elimination(how: Tiling = Tiling()) -> Recurrence:  # noqa: B008
    """Gaussian elimination without pivoting, in packed form: multipliers below the diagonal, the upper factor on and above it."""

    def roles(k: int) -> dict[str, Column]:
        i, j = F.col("bi"), F.col("bj")
        return {"A": (i == k) & (j == k), "B": (i == k) & (j > k), "C": (i > k) & (j == k), "D": (i > k) & (j > k)}

    def kernels(grid: Grid, k: int) -> dict:
        return {
            "A": lambda bi, bj, x: lu(x, how),
            "B": lambda bi, bj, x, a: solve_lower(a, x, how),
            "C": lambda bi, bj, x, a: solve_upper(a, x, how),
            "D": lambda bi, bj, x, u, v: subtract(x, u, v, how),
        }

    return Recurrence("ge", 0.0, None, False, False, roles, kernels)


def folding(weight: Weight, how: Tiling = Tiling()) -> Recurrence:  # noqa: B008
    """Protein accordion folding: S[i][j] = max(S[i][j], S[j+1][k] + F[j+1][min(k, 2j-i+1)]), k descending.

    D needs rows j + 1, so besides block (bj, k) it takes the first row of the block below that.
    """

    def roles(k: int) -> dict[str, Column]:
        i, j = F.col("bi"), F.col("bj")
        return {"A": (i == k) & (j == k), "B": (i < k) & (j == k), "D": j < k}

    def kernels(grid: Grid, k: int) -> dict:
        b = grid.block

        def d(bi: int, bj: int, x: np.ndarray, u: np.ndarray, halo: np.ndarray) -> np.ndarray:
            return fold(x, bi * b, bj * b, np.vstack([u, halo[:1]]), bj * b, k * b, grid.n, weight, how)

        return {
            "A": lambda bi, bj, x: fold(x, bi * b, bj * b, x, bi * b, k * b, grid.n, weight, how),
            "B": lambda bi, bj, x, a: fold(x, bi * b, bj * b, a, k * b, k * b, grid.n, weight, how),
            "D": d,
        }

    return Recurrence("paf", 0.0, None, True, True, roles, kernels, folds=True)
