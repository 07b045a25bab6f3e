"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; ``queries.py`` holds the thin
``opN_<name>`` queries and their SQL.
"""
