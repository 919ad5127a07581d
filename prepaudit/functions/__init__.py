"""Column-level helpers: every function takes columns and returns a column."""
