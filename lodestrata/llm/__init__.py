"""Operators for preparing training text, each a ``DataFrame -> DataFrame`` function.

Nothing outside this subpackage imports it.
"""
