"""Scalar functions: text, numbers, dates, similarity, tables."""
