"""Queries of the fact store, each with the same definition for Spark and for its oracle."""

from . import custom, extra, graph, projection, retrieve, store  # noqa: F401
from .catalog import PLANS

FLAGSHIP = "q_pack"

__all__ = ["FLAGSHIP", "PLANS"]
