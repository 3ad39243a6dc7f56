"""Operators for preparing language-model training data, one module per operator.

Nothing outside this subpackage imports it; ``queries.py`` holds the registered queries.
"""
