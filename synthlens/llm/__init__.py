"""Operators of a training-data pipeline over document tables.

Each module holds one operator with its own general interface; ``queries``
binds them to the given tables. Nothing outside this package imports it.
"""
