"""A property-valuation analytics engine and training-data operators on Spark."""
