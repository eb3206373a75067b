"""All queries of the library and their oracles."""

from __future__ import annotations

from . import payload_queries, scene_queries, tensor_queries, tile_queries  # noqa: F401
from .tile_queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
