"""All registered queries; importing a module registers its entries."""

from traceloom.plans.catalog import (  # noqa: F401
    aggregates,
    answers,
    cleaning,
    extract,
    files,
    graph,
    lookups,
    metrics,
    streams,
    vectors,
    windows,
)
from traceloom.plans.registry import all_queries, all_sql  # noqa: F401
