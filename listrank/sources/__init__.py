"""Readers and writers of the tables around an evaluation."""
