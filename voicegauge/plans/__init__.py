"""Query plans: the registry and the modules that fill it."""

from __future__ import annotations

import importlib

MODULES: list[str] = ["latency", "text", "grid", "streams"]


def load_all():
    """(queries, SQL twins) of every plan module."""
    from voicegauge.plans import registry

    for name in MODULES:
        importlib.import_module(f"voicegauge.plans.{name}")
    return registry.QUERIES, registry.ORACLE
