"""Composite jobs, and the catalogue that binds operators to the test tables."""
