"""Operators of the retrieval engine."""
