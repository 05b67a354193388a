"""Analytics over token-level annotation data, written for Spark."""
