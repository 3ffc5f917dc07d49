"""Operators for preparing training data at cluster scale.

Nothing else in the library imports this subpackage; its queries are listed in
:mod:`spanlight.llm.queries`.
"""
