"""Column functions: scoring, vectors, text, masking."""
