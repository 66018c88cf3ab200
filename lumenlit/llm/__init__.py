"""Operators for building language-model training data at cluster scale.

Nothing else in the library imports this subpackage; ``queries.py`` holds the
registered queries and their SQL.
"""
