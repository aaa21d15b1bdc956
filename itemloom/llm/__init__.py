"""Operators for preparing large text corpora; nothing else in the package imports this one.

Every operator takes a DataFrame and column names, selects only the columns it
needs (so extra or clashing columns of the input are harmless) and returns its
own columns beside the key.
"""
