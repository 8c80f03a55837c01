"""Operators that prepare training corpora: scoring, deduplication, decontamination, packing, sharding, archives.

Nothing outside this subpackage imports it.
"""
