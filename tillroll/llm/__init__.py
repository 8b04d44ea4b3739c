"""Operators that prepare training text, and their queries. Nothing else in the package imports this subpackage."""
