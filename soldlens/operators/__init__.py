"""Operators of the sold-price engine."""
