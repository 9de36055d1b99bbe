"""Sources of the opening-matching engine."""
