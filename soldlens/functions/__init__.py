"""Functions of the sold-price engine."""
