"""Operators: every one is a lazy DataFrame to DataFrame function."""
