"""Operators for preparing training text: one module for each operator.

Nothing outside this subpackage imports it.
"""
