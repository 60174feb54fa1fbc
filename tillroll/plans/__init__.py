"""Whole feature sets, models, and the registered queries."""
