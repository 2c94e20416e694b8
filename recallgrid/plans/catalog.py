"""The registry of queries: name, DataFrame plan over a workspace, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, workspace

Plan = Callable[[Workspace], DataFrame]
PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Plan], Plan]:
    def put(plan: Plan) -> Plan:
        key = name or plan.__name__
        if key in PLANS:
            raise ValueError(f"two plans named {key}")
        PLANS[key] = plan
        if sql is not None:
            ORACLES[key] = sql
        return plan

    return put


def r(col: str | Column, digits: int = 6) -> Column:
    """Rounded, under its own name if it has one."""
    out = F.round(F.col(col) if isinstance(col, str) else col, digits)
    return out.alias(col) if isinstance(col, str) else out


def n(col: str | Column, alias: str | None = None) -> Column:
    """As a long."""
    out = (F.col(col) if isinstance(col, str) else col).cast("long")
    return out.alias(alias or col) if isinstance(col, str) or alias else out


def load() -> None:
    from . import q_data, q_models, q_read, q_sets, q_stats, q_store, q_tune  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return {k: (lambda spark, sf_dir, p=p: p(workspace(spark, sf_dir))) for k, p in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return dict(ORACLES)
