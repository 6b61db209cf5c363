"""Registry of the engine's queries; every module in plans/ contributes (function, oracle SQL) pairs."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from tessella import plans


def _modules():
    for found in sorted(pkgutil.iter_modules(plans.__path__), key=lambda m: m.name):
        yield importlib.import_module(f"tessella.plans.{found.name}")


def queries() -> dict[str, Callable]:
    out: dict[str, Callable] = {}
    for module in _modules():
        out |= getattr(module, "QUERIES", {})
    return out


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in _modules():
        out |= getattr(module, "ORACLES", {})
    return out
