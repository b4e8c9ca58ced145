"""Whole comparisons: from two tables or files to differences, summary and metrics."""
