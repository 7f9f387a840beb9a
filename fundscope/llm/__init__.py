"""Operators for preparing language-model training data.

Each module holds one operator with its own interface plus the thin query that
applies it to a table.  ``QUERIES`` / ``ORACLE_SQL`` in :mod:`.registry` list
the queries; nothing outside this subpackage imports it except the entry module.
"""
