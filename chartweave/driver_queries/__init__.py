"""Queries over the driver's tables, by group."""

from chartweave.driver_queries import charts, checks, delivery, dumps, exchange, fhir, mapping, relational, scalars, sinks, streams  # noqa: F401
from chartweave.driver_queries.base import QUERIES, SQL  # noqa: F401
