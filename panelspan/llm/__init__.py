"""Operators for preparing training text at scale. Nothing outside this package imports it.

Each module holds one operator with its own general interface; ``queries`` registers the thin queries over the
standard tables, ``checks`` the SQL that can verify them.
"""
