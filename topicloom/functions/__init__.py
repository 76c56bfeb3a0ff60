"""Column expressions: no shuffle, no Python in the hot path."""
