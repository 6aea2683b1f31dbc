"""Column-in, Column-out helpers."""
