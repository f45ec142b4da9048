"""Column functions: weights, directions, polylines."""
