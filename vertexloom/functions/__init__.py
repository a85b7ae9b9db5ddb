"""Column functions of the graph library."""
