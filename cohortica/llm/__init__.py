"""Operators for preparing language-model training data at scale.

Nothing outside this folder imports it.  Queries are registered by
``cohortica.llm.queries``.
"""
