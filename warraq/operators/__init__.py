"""Operators from pages to results."""
