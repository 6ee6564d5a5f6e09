"""The catalogue of conversions, and queries over the driver's tables."""
