"""Operators of a training-data pipeline over ``documents``, ``pages``,
``benchmark``, ``labels`` and ``conversations``.

Each module holds one operator; ``queries`` registers them.  Nothing outside
this subpackage imports it.
"""
