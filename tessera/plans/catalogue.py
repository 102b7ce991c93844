"""All queries of the engine's operators."""

from tessera.plans import analysis, naming, queries, tables  # noqa: F401  (they register their queries)
from tessera.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
