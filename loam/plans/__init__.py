"""Registered queries over the test tables, each with its SQL oracle."""

from . import filters, keyed, layout

QUERIES = {**keyed.QUERIES, **layout.QUERIES, **filters.QUERIES}
ORACLES = {**keyed.ORACLES, **layout.ORACLES, **filters.ORACLES}
