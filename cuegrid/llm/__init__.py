"""Operators for training-data pipelines. Nothing else in cuegrid imports this subpackage."""
