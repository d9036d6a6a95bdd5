"""Queries over the given tables, one per operator, each next to the SQL that checks it."""

import importlib
import pkgutil

from notegrid.probes.registry import ORACLES, QUERIES

for _module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    if _module != "registry":
        importlib.import_module(f"{__name__}.{_module}")

__all__ = ["ORACLES", "QUERIES"]
