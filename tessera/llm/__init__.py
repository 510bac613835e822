"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it; removing the folder leaves the
rest of the library intact.
"""
