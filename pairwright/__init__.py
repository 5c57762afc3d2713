"""Two-sided co-location analytics as Spark DataFrame transforms."""
