"""Operators for preparing training data: tokenising, cleaning, deduplicating, searching and sharding text at scale.

Nothing else in the library imports this subpackage. ``queries`` holds the registered queries and their DuckDB SQL.
"""
