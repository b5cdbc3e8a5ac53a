"""Operators that prepare training text; nothing outside this subpackage imports it."""
