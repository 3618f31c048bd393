"""Column expressions, fixed values and small dimension tables."""
