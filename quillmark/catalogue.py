"""Every registered query over questions, catalogues and reports, with its SQL."""

from __future__ import annotations

from quillmark.plans import bounds_queries, catalogue_queries, detection_queries, facet_queries, ordered_queries, page_queries, report_queries, selection_queries, text_queries, topic_queries, tree_queries

_MODULES = (facet_queries, ordered_queries, report_queries, selection_queries, text_queries, detection_queries, topic_queries, tree_queries, page_queries, bounds_queries, catalogue_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL: dict[str, str] = {name: text for m in _MODULES for name, text in m.SQL.items()}
