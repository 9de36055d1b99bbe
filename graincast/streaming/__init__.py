"""Streaming of the opening-matching engine."""
