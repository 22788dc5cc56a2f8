"""Column expressions: indices, geometry, affine transforms."""
