"""Operators for building language-model training data. Nothing outside this package imports it."""
