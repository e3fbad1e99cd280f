"""Training-data operators: ten numbered operators, one module each.

Nothing else in the library imports this subpackage.
"""
