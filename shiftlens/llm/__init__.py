"""Training-data operators: quality, search, tokens, archives, dedup, decontamination, filters, secrets and mixing.

Nothing else in the library imports this subpackage.
"""
