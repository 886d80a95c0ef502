"""Operators that a training-data pipeline needs, each by its own method.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
queries and ``QUERIES`` / ``ORACLES`` their names.
"""
