"""Registered queries: each applies one operator to the driver's tables, with SQL for the same rows where SQL can say it."""

import importlib

#: Modules whose import fills the registry.
MODULES = ["metrics", "windows", "aggregates", "compare", "joins", "models", "sources", "jobs"]


def _load():
    from gaugeflow.plans import registry

    for name in MODULES:
        importlib.import_module(f"gaugeflow.plans.{name}")
    return registry


def queries() -> dict:
    return dict(_load().QUERIES)


def oracles() -> dict[str, str]:
    return dict(_load().ORACLES)
