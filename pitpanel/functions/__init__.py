"""Column functions: null-safe numbers and text."""
