"""Functions of the price-catalog engine."""
