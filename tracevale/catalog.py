"""The catalogue of queries over the driver's tables, and their SQL."""

from .plans.catalogue import QUERIES
from .plans.oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
