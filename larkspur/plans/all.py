"""Imports every module that registers queries."""

from __future__ import annotations

from larkspur.plans import lexical, neighbours, retrieval, routing, structure, tiers  # noqa: F401
from larkspur.plans.registry import REGISTRY, Query  # noqa: F401
