"""Operators of a training-data pipeline: language ID, mixing, secret scans, URL filters,
substring dedup, quality rules, fingerprints, packing, similarity join and WARC archives.

Nothing outside this subpackage imports it.
"""
