"""Operators for preparing training text, one per module."""
