"""Plans of the price-catalog engine."""
