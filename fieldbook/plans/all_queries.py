"""Every query of the library but those of the llm subpackage."""

from fieldbook.plans import aggregate_queries, graph_queries, join_queries, model_queries, scalar_queries, series_queries, serve_queries, source_queries, stats_queries, stream_queries, temporal_queries  # noqa: F401
from fieldbook.plans.registry import QUERIES, SQL  # noqa: F401
