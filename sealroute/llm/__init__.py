"""Training-data operators: formatting, filtering, deduplication, detection and mixing of text tables.

Nothing outside this subpackage imports it.
"""
