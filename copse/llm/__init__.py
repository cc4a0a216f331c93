"""Training-data operators: packing, fingerprints, filters, dedup, search, scans and byte-level BPE.

Nothing else in the library imports this subpackage.
"""
