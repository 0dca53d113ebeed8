"""Operators for preparing language-model training data.

Nothing outside this package imports it; ``queries.QUERIES`` holds the
registered queries and ``queries.ORACLES`` the SQL of those that SQL can express.
"""
