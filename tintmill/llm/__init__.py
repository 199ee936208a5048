"""Training-data operators. Nothing else in tintmill imports this package."""
