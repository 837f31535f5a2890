"""All registered queries."""

from leadwake.plans import catalog_events, catalog_labels, catalog_market, catalog_network, catalog_quality, catalog_sources  # noqa: F401
from leadwake.plans.registry import ORACLES, QUERIES  # noqa: F401
