"""Training-data operators: quality, dedup, packing, tokenizing, PII and sharding.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
