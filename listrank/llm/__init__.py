"""Operators for preparing language-model training data, each a plain DataFrame function."""
