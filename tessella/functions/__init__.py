"""Column expressions and small per-value functions."""
