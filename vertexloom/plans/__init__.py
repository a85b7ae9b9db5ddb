"""Execution helpers shared by iterative plans."""
