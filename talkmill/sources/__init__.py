"""Sources of the corpus engine."""
