"""Operators for preparing language-model training data.

Each module holds one operator. ``queries`` lists the registered queries. Nothing outside this
subpackage imports it.
"""
