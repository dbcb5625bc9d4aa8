"""DuckDB statements that say what each registered query must return."""
