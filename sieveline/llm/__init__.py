"""Operators for training-data preparation: one module per problem.

Nothing outside this subpackage imports it. ``queries`` holds the registered queries.
"""
