"""Column functions: text cleaning, counts, identifiers."""
