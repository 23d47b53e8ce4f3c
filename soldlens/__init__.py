"""soldlens: sold-price analytics on Spark DataFrames."""
