"""Named queries over the driver tables and the SQL twin of each."""

from larmor.plans.queries import queries
from larmor.plans.sql import oracle_sql

__all__ = ["oracle_sql", "queries"]
