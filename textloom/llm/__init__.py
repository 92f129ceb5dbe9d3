"""Training-data operators: packing, mixing, near-dedup, scans, classifiers, archives.

Nothing outside this package imports it; deleting the folder leaves the rest working.
"""
