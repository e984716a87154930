"""Training-data operators: one module per operator, plus the queries that apply them.

Nothing outside this subpackage imports it.
"""
