"""Operators on candidate lists, interactions and items."""
