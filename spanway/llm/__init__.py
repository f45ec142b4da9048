"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage.  ``queries.py`` lists the
registered queries; every other module holds one operator with its own general
interface.
"""
