"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage.  Each operator module has a
general interface; ``queries`` holds the thin registered queries and ``oracles``
their SQL.
"""
