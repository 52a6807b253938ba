"""Every query of the library outside the training-data subpackage, with its SQL."""

from __future__ import annotations

from glossa.plans import queries as _queries
from glossa.plans.oracle import ORACLE_SQL

QUERIES = {name: f for name, f in vars(_queries).items() if callable(f) and getattr(f, "__module__", "") == _queries.__name__ and not name.startswith("_")}

__all__ = ["ORACLE_SQL", "QUERIES"]
