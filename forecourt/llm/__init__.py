"""Operators for building training data. Nothing else in the package imports this folder.

Each module holds one operator with its own general interface; ``queries`` holds the thin named
queries that apply them to whole tables, and ``oracles`` the SQL they are checked against.
"""
