"""Merging. Which physical join runs, and whether a side is broadcast, is left to Catalyst and its statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from grainmill.functions.core import as_list, named, require


def df_merge(data1: DataFrame, data2: DataFrame, on_index: bool = True, on_column: str | Sequence[str] | bool = False, index: str | Sequence[str] | None = None, null_safe: bool = True) -> DataFrame:
    """Inner equi-join on on_column, or on the key columns `index` that stand for a frame's index.

    Missing keys match each other unless null_safe is off. Other columns that both sides have get the suffixes _x and _y.
    """
    if on_index is True and on_column is False:
        if index is None:
            raise ValueError("a frame has no implicit index here: name its key columns with index=")
        keys = as_list(index)
    else:
        keys = as_list(on_column)
    require(data1, keys), require(data2, keys)
    left, right = data1.alias("l"), data2.alias("r")
    q = lambda side, c: F.col(f"{side}.`{c}`")
    on = None
    for k in keys:
        same = q("l", k).eqNullSafe(q("r", k)) if null_safe else q("l", k) == q("r", k)
        on = same if on is None else on & same
    both = (set(data1.columns) & set(data2.columns)) - set(keys)
    mine = [q("l", c).alias(f"{c}_x" if c in both else c) for c in data1.columns]
    theirs = [q("r", c).alias(f"{c}_y" if c in both else c) for c in data2.columns if c not in keys]
    return left.join(right, on, "inner").select(*mine, *theirs)


def glue(*frames: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Several aggregates over the same key side by side."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, as_list(on), "inner")
    return out.select(*(named(c) for c in out.columns))
