"""All queries of the core, with the SQL of those that SQL can express."""

from __future__ import annotations

from strandweave.plans import evaluation_queries, grid_queries, model_queries, partition_queries, run_queries, variant_queries

FLAGSHIP = "silhouette_l5"
QUERIES = {**model_queries.QUERIES, **evaluation_queries.QUERIES, **variant_queries.QUERIES, **partition_queries.QUERIES, **run_queries.QUERIES, **grid_queries.QUERIES}
ORACLES = {**model_queries.ORACLES, **evaluation_queries.ORACLES, **variant_queries.ORACLES, **partition_queries.ORACLES, **run_queries.ORACLES, **grid_queries.ORACLES}
