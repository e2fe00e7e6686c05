"""Registered queries over the driver tables, each with its DuckDB twin where SQL can express it."""

from . import gates, likeness, nested, ordered, passages, rules, segments, signal, streams, tables, text
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "gates", "likeness", "nested", "ordered", "passages", "rules", "segments", "signal", "streams", "tables", "text"]
