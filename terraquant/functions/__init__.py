"""Column expressions, keyed hashing, exact order statistics and small matrix maths."""
