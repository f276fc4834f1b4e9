"""Operators for preparing training text, each usable on any table with the named columns."""
