"""Operators that prepare and audit text corpora for language-model training.

Nothing outside this folder imports it.  Every operator takes DataFrames and
returns DataFrames; ``queries.py`` applies them to the driver's tables.
"""
