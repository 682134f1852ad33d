"""The catalogue: importing this module registers every query."""

from __future__ import annotations

from . import aggregates, joins, records, statistics, texts, windows
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregates", "joins", "records", "statistics", "texts", "windows"]
