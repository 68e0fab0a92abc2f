"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage; the driver entry adds its
queries only where the subpackage can be imported.
"""
