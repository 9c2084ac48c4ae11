"""Registered queries; importing this package fills the registry."""

import importlib

MODULES = ("validation", "constraints", "regression", "tracing", "operations", "documents", "ifcmodels", "imports", "intake", "streams")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"modelgauge.plans.{name}")
