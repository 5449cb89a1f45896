"""Operators for large training-data pipelines. Nothing else in docloom imports this subpackage."""
