"""Column helpers: Columns in, Columns out."""
