"""Collects every registered query."""

from tablekeeper.plans import (  # noqa: F401
    chunk_queries,
    fleet_queries,
    history_queries,
    lineage_queries,
    masking_queries,
    snapshot_queries,
    streaming_queries,
    text_queries,
)
from tablekeeper.plans.registry import QUERIES, SQL  # noqa: F401
