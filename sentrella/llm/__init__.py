"""Operators for large-scale training-data preparation.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
when it is present.
"""
