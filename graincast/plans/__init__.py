"""Plans of the opening-matching engine."""
