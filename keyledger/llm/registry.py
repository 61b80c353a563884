"""The queries of the subpackage and the SQL of those that have it."""

from __future__ import annotations

from keyledger.llm import decontaminate, html_text, near_dup, substring_dup, tokens, toxicity, url_filter, vector_search, warc

_MODULES = (decontaminate, html_text, near_dup, substring_dup, tokens, toxicity, url_filter, vector_search, warc)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
