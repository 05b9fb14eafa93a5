"""Scalar functions and vocabularies, as Column expressions."""
