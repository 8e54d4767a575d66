"""Column functions: typed values, pixel arithmetic, identifiers."""
