"""Training-data operators: media columns, near-duplicates, token files, packing,
chat formatting, web archives, quality and language models.

Nothing else in the library imports this subpackage.
"""
