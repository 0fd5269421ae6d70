"""Operators for preparing text corpora at scale.

Nothing else in the library imports this subpackage.  Each ``opN`` module holds
a general operator; ``queries`` applies every operator to its whole table.
"""
