"""Column-level functions: separators, whitespace, syllables, scores of adjacent units."""
