"""Operators for large training-data pipelines: text, mixing, scoring and near-duplicate work."""
