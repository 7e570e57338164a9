"""Operators for building large training corpora.

Nothing else in the library imports this subpackage; its queries are in ``tracewell.llm.queries``.
"""
