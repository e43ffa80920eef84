"""Operators on training text; nothing else in the library imports this subpackage."""
