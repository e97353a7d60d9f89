"""Operators of the price-catalog engine."""
