"""Column builders: distances, vectors, text."""
