"""Streaming of the sold-price engine."""
