"""All registered queries of the library and their DuckDB counterparts."""

from __future__ import annotations

from tidewater.plans import audit_queries, cycle_queries, evaluation_queries, feature_queries, metric_queries, micro_queries, model_queries

MODULES = [feature_queries, micro_queries, metric_queries, cycle_queries, model_queries, evaluation_queries, audit_queries]
FLAGSHIP = "bars_rolling_statistics"
QUERIES = {k: f for m in MODULES for k, f in m.Q.items()}
ORACLES = {k: q for m in MODULES for k, q in m.O.items()}
