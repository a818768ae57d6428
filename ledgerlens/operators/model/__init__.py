"""Folds, class-balanced random forests, exact evaluation curves, search and importances."""
