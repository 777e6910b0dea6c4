"""Joins whose many-side may hold a hot key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_match(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in zip(left, right)])


def keep_all(
    parents: DataFrame, children: DataFrame, parent_keys: Sequence[str], child_keys: Sequence[str]
) -> DataFrame:
    """Every parent with its children, parents without any once: an outer join.

    An outer join can neither split the side whose rows may be missing nor broadcast the side
    that is kept. As an inner join plus the parents no child names, a parent with a third of
    all children is split over tasks, and few parents are broadcast. Child keys are made
    distinct map-side before they are compared. The two sides share no column name.
    """
    match = key_match(parent_keys, child_keys)
    named = children.select(*child_keys).distinct()
    alone = parents.join(named, match, "left_anti")
    return parents.join(children, match).unionByName(alone, allowMissingColumns=True)


def having(
    rows: DataFrame, others: DataFrame, keys: Sequence[str], other_keys: Sequence[str]
) -> DataFrame:
    """Rows whose key occurs among the others."""
    return rows.join(others.select(*other_keys).distinct(), key_match(keys, other_keys), "left_semi")


def lacking(
    rows: DataFrame, others: DataFrame, keys: Sequence[str], other_keys: Sequence[str]
) -> DataFrame:
    """Rows whose key does not occur among the others; a NULL key occurs nowhere."""
    return rows.join(others.select(*other_keys).distinct(), key_match(keys, other_keys), "left_anti")
