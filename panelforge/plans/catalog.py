"""All registered queries (importing the modules fills the registry)."""

from __future__ import annotations

from panelforge.plans import (  # noqa: F401
    q_agg,
    q_chain,
    q_core,
    q_eval,
    q_features,
    q_fill,
    q_linear,
    q_misc,
    q_models,
    q_more,
    q_order,
    q_search,
    q_surface,
    q_trees,
)
from panelforge.plans.registry import OPERATORS, ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE", "OPERATORS"]
