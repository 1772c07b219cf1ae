"""Registered queries over the given tables; importing a module of plans registers its queries."""

from fabula.plans import agreement, composites, reports, retrieval, story, tables, texts  # noqa: F401
from fabula.plans.registry import QUERIES, SQL  # noqa: F401
