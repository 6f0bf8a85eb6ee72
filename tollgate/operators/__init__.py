"""Operators: each is ``fn(tables..., clock, **args) -> DataFrame``, lazily planned."""
