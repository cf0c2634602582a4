"""Registered queries of the analytics engine, with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("bar_queries", "feature_queries", "analytics_queries", "ledger_queries", "portfolio_queries", "study_queries", "strategy_queries", "alignment_queries", "research_queries", "validation_queries", "report_queries", "rule_queries", "simulator_queries", "mask_queries", "campaign_queries", "bundle_queries")


def _registries() -> list:
    return [importlib.import_module(f"barline.plans.{name}").R for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for r in _registries() for k, v in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for r in _registries() for k, v in r.sql.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["trade_metrics"](spark, sf_dir)
