"""All registered queries."""

from tessera.catalog import content, events, flow, lineage, paging, state, text  # noqa: F401
from tessera.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
