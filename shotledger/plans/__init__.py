"""Queries put together from the operators, with SQL to hold them against."""
