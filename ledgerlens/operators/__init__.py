"""DataFrame operators: aggregates, exact selection, labels, splits, similarity, models."""
