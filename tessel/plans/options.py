"""What a solve can be told."""

from __future__ import annotations

from dataclasses import dataclass

from tessel.functions.grid import PLACEMENTS, Grid
from tessel.functions.kernels import Tiling

PROBLEMS = ("fw", "ge", "paf", "gap")
STRATEGIES = ("cells", "shuffle", "broadcast")
KERNELS = ("iterative", "tiled")
PERSIST = ("none", "memory", "disk")


@dataclass(frozen=True)
class SolveOptions:
    """
    strategy    cells: plain Catalyst on cells, for small tables; shuffle: blocks meet their operands
                by shuffled joins; broadcast: pivot blocks are broadcast while they have at most
                `broadcast_bytes`, and shuffled beyond that
    grid        blocks on a side; 0: as many as make blocks of at most `block_rows` rows
    kernel      iterative, or tiled with `r_shared` tiles a side down to `base_size` rows
    placement   ph, md or cus (with `nodes` executors), over `partitions` partitions (0: the session's)
    persist     every pivot's table is written to the shared folder, so plans stay short and a lost
                executor costs a reread; memory and disk keep it in the executors' cache besides
    """

    strategy: str = "broadcast"
    grid: int = 0
    block_rows: int = 512
    kernel: str = "iterative"
    r_shared: int = 2
    base_size: int = 64
    partitions: int = 0
    placement: str = "ph"
    nodes: int = 1
    persist: str = "none"
    broadcast_bytes: int = 256 << 20

    def __post_init__(self):
        for name, value, known in (("strategy", self.strategy, STRATEGIES), ("kernel", self.kernel, KERNELS), ("placement", self.placement, PLACEMENTS), ("persist", self.persist, PERSIST)):
            if value not in known:
                raise ValueError(f"{name} is one of {', '.join(known)}, not {value!r}")
        if self.grid < 0 or self.block_rows < 1 or self.nodes < 1 or self.partitions < 0:
            raise ValueError("grid and partitions are at least 0, block_rows and nodes at least 1")

    def grid_of(self, n: int) -> Grid:
        return Grid(n, self.grid or -(-n // self.block_rows))

    @property
    def tiling(self) -> Tiling:
        return Tiling(self.kernel == "tiled", self.r_shared, self.base_size)
