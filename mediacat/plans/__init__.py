"""Composed jobs, the test views and the query registry."""
