"""Registered queries, each with a SQL statement of the same result where SQL can state it."""

from rosterlake.registry import groups, joins, loads, quality, reports, rows, sources, streams, synthesis  # noqa: F401
from rosterlake.registry.core import REGISTRY, statement

__all__ = ["REGISTRY", "statement"]
