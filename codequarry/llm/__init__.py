"""Operators for preparing training corpora, their queries and SQL. Nothing else in the library imports this."""
