"""Readers and the steps from files to pages."""
