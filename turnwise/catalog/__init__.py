"""Every operator as a query on the test tables, with the SQL that must give the same rows."""

from turnwise.catalog import (  # noqa: F401
    aggregates,
    joins,
    learning,
    projections,
    reshape,
    sources,
    statistics,
    text,
    windows,
)
from turnwise.catalog.registry import ORACLES, QUERIES, Tables  # noqa: F401
