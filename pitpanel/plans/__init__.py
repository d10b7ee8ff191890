"""The feature language, its compiler, models, the search, and the registered queries."""
