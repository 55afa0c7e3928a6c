"""Operators for training-data pipelines; nothing else in quire imports this subpackage."""
