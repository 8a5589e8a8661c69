"""Operators of a training-data pipeline over ``documents``.

Nothing outside this subpackage imports it.
"""
