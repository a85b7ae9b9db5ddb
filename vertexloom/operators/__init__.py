"""Part of the vertexloom graph library."""
