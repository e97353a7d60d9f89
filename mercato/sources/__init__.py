"""Sources of the price-catalog engine."""
