"""Operators that prepare training text: one module per operator, queries and SQL in ``queries``."""
