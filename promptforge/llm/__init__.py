"""Corpus operators for training-data pipelines.

Ten operators, one module each, over ``documents(doc_id, text, lang, source)``
and the other corpus tables.  Nothing else in the library imports this
subpackage; ``queries.py`` holds the registered queries and their SQL.
"""
