"""Column expressions: text, numbers, tokens."""
