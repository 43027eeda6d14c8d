"""Training-data operators: mixing, token files, packing, toxicity, fingerprints,
chat formatting, line and n-gram and embedding near-duplicates, and WARC output.

Nothing outside this subpackage imports it.
"""
