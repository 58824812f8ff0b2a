"""Column expressions: calendar parts, stable hashing, click-through arithmetic."""
