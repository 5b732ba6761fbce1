"""The registered queries: operators over the tables of a folder, with the same in DuckDB's SQL."""

from . import failures, frames, kpi, learning, logs, results, streams, triage
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "failures", "frames", "kpi", "learning", "logs", "results", "streams", "triage"]
