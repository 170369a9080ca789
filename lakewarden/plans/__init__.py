"""Operators put together: the governed run, and the queries over the test tables."""
