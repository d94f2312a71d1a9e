"""Operators on sparse matrices and dense vectors."""
