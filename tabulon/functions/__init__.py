"""Column functions: text structure, portable patterns, arrays and closed-form statistics."""
