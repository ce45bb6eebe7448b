"""Training-data operators: dedup, decontamination, tokens, PII, language, shards.

Nothing outside this subpackage imports it; deleting the folder leaves the
rest of the library working.
"""
