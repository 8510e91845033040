"""Operators for preparing language-model training data at corpus scale.

Nothing outside this subpackage imports it.
"""
