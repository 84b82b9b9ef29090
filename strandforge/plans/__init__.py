"""Composite pipelines over the operators."""
