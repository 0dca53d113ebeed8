"""Sources and sinks: typed readers, fixture derivation, report writers."""

from strikeflow.sources.readers import read_lolp, read_params, read_prices, read_settlement, read_ticks
from strikeflow.sources.fixtures import (
    ticks_from_events,
    settlement_from_events,
    lolp_fixture,
    load_fixture,
)
from strikeflow.sources.sinks import publish_reports, published_report, remove_unpublished, write_reports, write_ticks

__all__ = [
    "read_ticks",
    "read_settlement",
    "read_lolp",
    "read_params",
    "read_prices",
    "ticks_from_events",
    "settlement_from_events",
    "lolp_fixture",
    "load_fixture",
    "publish_reports",
    "published_report",
    "remove_unpublished",
    "write_reports",
    "write_ticks",
]
