"""Column functions: grids, masks, scalars, statistics."""
