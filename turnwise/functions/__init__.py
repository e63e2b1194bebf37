"""Column builders: text, vectors, portable random draws."""
