"""Operators for preparing training text, each registered as a query."""
