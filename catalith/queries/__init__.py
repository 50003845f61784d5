"""Registered queries, by subject."""

from . import details, functions, history, prices, products, reading, records, shop_pages, streams, telemetry  # noqa: F401
