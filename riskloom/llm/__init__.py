"""Training-data operators: token counts, language models, search, near-duplicates, packing and formats.

Nothing else in the package imports from here; the folder can be deleted.
"""
