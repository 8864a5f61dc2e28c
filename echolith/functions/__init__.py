"""Column functions over array-valued signals, and the numpy kernels behind the Arrow ones."""
