"""Training-data operators: deduplication, mixing, packing, extraction, media and scoring.

Nothing outside this subpackage imports it.
"""
