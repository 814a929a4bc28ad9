"""Whole jobs, and the catalog of checked queries."""
