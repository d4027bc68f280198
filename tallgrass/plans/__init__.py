"""Composed queries over the test tables, each with SQL for another engine."""
