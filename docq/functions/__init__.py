"""Column functions: text, numbers, metrics, geometry, tokens and ids."""
