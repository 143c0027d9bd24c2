"""Training-data operators: duplicates, mixing, coverage, near-duplicates, overlap, encoding, packing, language.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries only if it is there.
"""
