"""Column functions: score coercion, text, statistics."""
