"""Queries and commands built from the operators."""
