"""Column expressions and pure helpers."""
