"""All registered queries of the library and their SQL."""

from __future__ import annotations

from . import convert_queries, docx_queries, file_queries, folder_queries, paper_queries, picture_queries, repair_queries, sql_queries, text_queries

MODULES = (text_queries, paper_queries, docx_queries, repair_queries, convert_queries, picture_queries, folder_queries, file_queries, sql_queries)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL: dict[str, str] = {k: v for m in MODULES for k, v in m.SQL.items()}
