"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; :mod:`terrace.llm.queries` has the thin
queries that apply them to the shared tables, and their SQL where there is any.
"""
