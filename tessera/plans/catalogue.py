"""The queries by name and their equivalents in SQL."""

from __future__ import annotations

from tessera.plans import civic, flows, matters, pages, records, search, site  # noqa: F401  the modules enter their queries
from tessera.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
