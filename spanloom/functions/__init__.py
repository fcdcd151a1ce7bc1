"""Column functions of the annotation layers."""
