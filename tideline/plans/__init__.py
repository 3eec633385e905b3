"""Registered queries."""

from __future__ import annotations

import importlib

_MODULES = ["indicators", "cleaning", "joins", "quality", "splits", "evaluation", "trading", "regimes", "trials", "io"]


def _load():
    for m in _MODULES:
        importlib.import_module(f"tideline.plans.{m}")


def all_queries():
    from tideline.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_oracles():
    from tideline.plans.registry import ORACLES

    _load()
    return dict(ORACLES)
