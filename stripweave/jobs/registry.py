"""All registered queries of the core library with their SQL."""

from __future__ import annotations

from . import attributes, estimates, following, hits, selections, shapes, tracks, trees  # noqa: F401  fill the tables
from .register import ORACLES, QUERIES, Query, query  # noqa: F401

FLAGSHIP = "j3_adjacent_links"
