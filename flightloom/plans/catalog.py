"""All registered queries."""

from flightloom.plans import (  # noqa: F401
    catalog_functions,
    catalog_coverage,
    catalog_windows,
    catalog_joins,
    catalog_pairs,
    catalog_reports,
    catalog_stateful,
    catalog_graph,
    catalog_sources,
)
from flightloom.plans.registry import ORACLES, QUERIES  # noqa: F401
