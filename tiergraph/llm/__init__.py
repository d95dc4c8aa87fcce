"""Operators for large training corpora: quality, extraction, matching, scoring, packing.

Nothing outside this subpackage imports it.
"""
