"""Functions of the opening-matching engine."""
