"""All registered queries and their SQL, gathered from the modules of ``waymark.plans``."""

from __future__ import annotations

import importlib
import pkgutil

from waymark import plans
from waymark.plans.base import COVERS, ORACLE_SQL, QUERIES

for _module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
    importlib.import_module(f"waymark.plans.{_module}")

FLAGSHIP = "tfidf_topk"

__all__ = ["COVERS", "FLAGSHIP", "ORACLE_SQL", "QUERIES"]
