"""pairlens: preference-data feature analytics on Spark."""
