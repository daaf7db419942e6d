"""Column expressions of the block grid, and numpy kernels on blocks."""
