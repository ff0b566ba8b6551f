"""Registered queries over the driver's tables, each next to its SQL."""

from . import registry
from .registry import QUERIES, SQL  # noqa: F401


def load():
    """Import every query module once; registration happens on import."""
    from . import cleaning, counting, entities, events, ingesting, reporting, trends  # noqa: F401

    return registry.QUERIES, registry.SQL
