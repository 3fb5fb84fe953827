"""Operators on panels: one module for each family."""
