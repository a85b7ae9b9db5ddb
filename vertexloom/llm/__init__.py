"""Operators for cleaning and searching large text corpora."""
