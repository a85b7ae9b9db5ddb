"""Graph analytics."""
