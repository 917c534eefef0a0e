"""Operators for preparing large text corpora.

Each module holds one operator; ``queries`` registers them over the provided
tables.  Nothing else in the library imports this subpackage.
"""
