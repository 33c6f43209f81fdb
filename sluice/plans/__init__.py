"""Ready-made queries, one per operator, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

from sluice.plans import (  # noqa: F401  (importing registers the plans)
    clauses,
    expressions,
    grouping,
    joins,
    listing,
    overview,
    sinks,
    sources,
    standard,
    streams,
    surface,
)
from sluice.plans.registry import PLANS, Plan, Tables

__all__ = ["PLANS", "Plan", "Tables"]
