"""Operators of a training-data pipeline: cleaning, deduplication, scanning and mixing of document tables.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds its queries when it is present.
"""
