"""Sources of the sold-price engine."""
