"""Column functions: text primitives and scalar helpers."""
