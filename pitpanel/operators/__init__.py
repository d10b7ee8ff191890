"""Relational operators on panels: as-of joins, labels, features, splits, scores."""
