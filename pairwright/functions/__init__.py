"""functions of the two-sided co-location engine."""
