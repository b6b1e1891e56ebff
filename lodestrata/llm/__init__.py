"""Operators for language-model training data.

Nothing outside this subpackage imports it.  ``lodestrata.llm.queries`` holds
the thin query of each operator, ``lodestrata.llm.oracles`` their SQL.
"""
