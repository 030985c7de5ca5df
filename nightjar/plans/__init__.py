"""Composed jobs, rule content and the registered queries."""
