"""Operators of the opening-matching engine."""
