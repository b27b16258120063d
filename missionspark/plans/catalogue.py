"""All registered queries over the given tables, with their SQL."""

from __future__ import annotations

from . import registry
from . import files, missions, scenes, streams, tables  # noqa: F401  they register their queries

FLAGSHIP = "k1_vector_topk"


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
