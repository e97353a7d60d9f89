"""Streaming of the price-catalog engine."""
