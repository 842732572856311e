"""Training-data operators: extraction, deduplication, filtering, packing.

Nothing outside this subpackage imports it.
"""
