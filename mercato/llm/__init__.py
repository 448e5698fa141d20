"""Training-data operators: packing, quality, decontamination, deduplication,
token counts, pseudonyms, URL rules and language identification.

Nothing else in the library imports this subpackage.  Each operator lives in
its own module with a general interface; ``queries`` holds the thin
registered queries and their SQL.
"""
