"""All queries of the library's own operators and their SQL."""

from __future__ import annotations

# importing a module registers its queries
from tempestry.plans import analyses, centres, corrections, fields, frames, guards, levers, observations, pixels, records, registry, reports, selection, stages, stores, streams, tracks, whole  # noqa: F401


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
