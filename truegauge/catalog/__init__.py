"""Every operator bound to the driver tables, with SQL twins where SQL can express it."""

from __future__ import annotations

import importlib

MODULES = ("ingest", "cleaning", "shaping", "profiles", "ordering", "relations", "modelling", "streams")


def load():
    """(queries, SQL twins) of all catalog modules."""
    for m in MODULES:
        importlib.import_module(f"truegauge.catalog.{m}")
    from truegauge.catalog.registry import ORACLE, QUERIES

    return dict(QUERIES), dict(ORACLE)
