"""Operators for preparing language-model training data.

Nothing outside this folder imports it; ``queries`` and ``oracle_sql`` are what
the entry module adds when the folder is there.
"""

from attestra.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
