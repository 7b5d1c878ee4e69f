"""Registered queries over the given tables and the SQL each is checked with."""

from . import elements, evaluation, features, models, prep, refinement, scans, streams, text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
