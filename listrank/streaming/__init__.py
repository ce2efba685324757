"""Evaluation of lists that keep arriving."""
