"""Operators for corpora of training data. Nothing else in the library imports this subpackage."""
