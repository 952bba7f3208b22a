"""Column expressions: complex numbers, interpolation kernels, ranks and clamped windows."""
