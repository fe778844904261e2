"""Column functions: text, diffs, numbers, SQLite-like semantics."""
