"""Joins on series keys.

A NULL series key is a series like any other: every join on series keys
uses null-safe equality (``<=>``), which Spark still plans as a hash or
sort-merge equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left JOIN right`` on ``keys`` with NULL matching NULL; the output
    keeps the left key columns once (like ``join(..., on=keys)``)."""
    keys = list(keys)
    renamed = right.select(*[right[k].alias(f"__k_{k}") for k in keys],
                           *[right[c] for c in right.columns if c not in keys])
    cond = [left[k].eqNullSafe(renamed[f"__k_{k}"]) for k in keys]
    out = left.join(renamed, cond, how)
    if how in ("left_semi", "semi", "leftsemi", "left_anti", "anti", "leftanti"):
        return out
    return out.drop(*[f"__k_{k}" for k in keys])
