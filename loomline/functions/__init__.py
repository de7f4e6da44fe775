"""Column expressions: text, numbers, lists, vectors and statistics."""
