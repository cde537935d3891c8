"""Every query of the library by name, with its DuckDB equivalent where SQL can say it."""

from __future__ import annotations

from . import config_queries, document_queries, engine_queries, index_queries, relational_queries, stream_queries, text_queries, udf_queries

MODULES = [document_queries, text_queries, relational_queries, config_queries, engine_queries, index_queries, stream_queries, udf_queries]
QUERIES: dict = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: sql for m in MODULES for k, sql in m.ORACLES.items()}
# The same results under two names.
ORACLES |= {"usage_report": ORACLES["usage_summary"], "window_pack_overlap": ORACLES["window_pack_suffix"]}
