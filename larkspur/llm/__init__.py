"""Operators for preparing training data at corpus scale.

Nothing else in the library imports this subpackage; the repository entry
point adds its queries only where it can be imported.
"""
