"""Column expressions and column-list helpers shared by every job."""
