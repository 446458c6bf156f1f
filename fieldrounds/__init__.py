"""Analytics over records of repeated visits to places, written for Spark."""
