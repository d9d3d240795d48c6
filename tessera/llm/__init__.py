"""Operators for preparing large text corpora.

Nothing else in the library imports this subpackage.  Each module holds one operator; ``queries`` binds
them to the standard tables.
"""
