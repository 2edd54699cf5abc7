"""Operators for training text. Nothing else in tracemill imports this subpackage."""
