"""Column functions: everything that is computed from one row."""
