"""Operators that a training-data pipeline needs, beside the analytics of the rest of the library.

Nothing outside this subpackage imports it.
"""
