"""Column functions: angles and texts."""
