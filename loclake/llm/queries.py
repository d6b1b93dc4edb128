"""All queries of the subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib
import pkgutil

import loclake.llm as package

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in sorted(m.name for m in pkgutil.iter_modules(package.__path__) if m.name[:1] == "p" and m.name[1:3].isdigit()):
    _module = importlib.import_module(f"{package.__name__}.{_m}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
