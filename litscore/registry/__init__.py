"""Every operator as a query over the given tables, with SQL for what it must return."""

from litscore.registry.oracle import oracle_sql
from litscore.registry.queries import queries

__all__ = ["oracle_sql", "queries"]
