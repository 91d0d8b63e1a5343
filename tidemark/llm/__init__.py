"""Operators for preparing language-model training data.

Nothing outside this folder imports it; :mod:`tidemark.llm.queries` lists the
queries that the entry module registers when the folder is present.
"""
