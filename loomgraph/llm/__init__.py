"""Operators for training-corpus work. Nothing else in the package imports this subpackage."""
