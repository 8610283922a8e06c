"""Column functions and projections."""
