"""Training-data operators: deduplication, scoring, media, tokens, scans and mixing.

Nothing outside this subpackage imports it.
"""
