"""Where query modules register a Spark plan and, where SQL can say it, its oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

_PLANS: dict[str, Plan] = {}
_ORACLES: dict[str, str] = {}

MODULES = ("catalog", "quality", "text", "evidence", "state", "pages", "writes", "checks", "health", "documents", "trace", "live", "matching", "access")


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register the decorated plan under ``name`` with its oracle ``sql``."""

    def add(plan: Plan) -> Plan:
        if name in _PLANS:
            raise ValueError(f"two queries are named {name}")
        _PLANS[name] = plan
        if sql is not None:
            _ORACLES[name] = sql
        return plan

    return add


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"corrobora.plans.{module}")


def plans() -> dict[str, Plan]:
    _load()
    return dict(_PLANS)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
