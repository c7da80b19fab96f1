"""The state folds as streams."""
