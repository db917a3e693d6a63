"""Operators of the corpus engine."""
