"""Training-data operators: deduplication, quality, language, search, sharding, language-model scores, packing and mixing.

Nothing else in the library imports this subpackage.
"""
