"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Each module holds one operator;
``queries`` holds the registered queries and their SQL.
"""
