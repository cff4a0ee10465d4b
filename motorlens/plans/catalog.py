"""Everything that is registered, gathered in one place."""

from __future__ import annotations

from motorlens.plans import alert_queries, audit_queries, forecast_queries, ingest_queries, model_queries, report_queries, signal_queries, spectrum_queries, store_queries, stream_queries  # noqa: F401
from motorlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
