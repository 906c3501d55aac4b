"""Operators that prepare text for training: matching, linking, packing, mixing and language labels.

Nothing outside this package imports it.
"""
