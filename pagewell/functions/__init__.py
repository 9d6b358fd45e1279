"""Column-level functions over text and vectors."""
