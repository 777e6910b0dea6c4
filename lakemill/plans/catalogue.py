"""Collects every registered query by importing the modules that declare them."""

from __future__ import annotations

import importlib

from lakemill.plans.registry import ORACLES, QUERIES

MODULES = (
    "filters",
    "joins",
    "aggregates",
    "scalars",
    "routines",
    "views",
    "reports",
    "quality",
    "changes",
    "sources",
    "streams",
    "textvec",
)

for _name in MODULES:
    importlib.import_module(f"lakemill.plans.{_name}")


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
