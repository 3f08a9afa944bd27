"""All registered queries of the survey, price and regional operators, with their SQL."""

from __future__ import annotations

from .plans import checks, discontinuity, estimates, modules, pages, panels, regional, series, survey, views  # noqa: F401
from .registry import ORACLES, QUERIES, query  # noqa: F401
