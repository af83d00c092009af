"""Operators for preparing training data: packing, joins, formatting, filters, search and tokens.

Nothing else in the library imports this subpackage. ``entry`` holds its registered queries.
"""
