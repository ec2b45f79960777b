"""Training-data operators: one module per operator, DataFrame in, DataFrame out.

Nothing outside this subpackage imports it.
"""
