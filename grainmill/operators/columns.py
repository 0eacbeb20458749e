"""Column surgery: dropping, renaming, moving, splitting, selecting. No data is touched but by projections."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from grainmill.functions.core import TEMPORAL, as_list, named, kind, number_rows, require, with_columns


def df_drop_col(data: DataFrame, cols: str | Sequence[str], destructive: bool = False) -> DataFrame:
    """data without the columns; an absent one is an error."""
    gone = set(require(data, cols))
    return data.select(*(named(c) for c in data.columns if c not in gone))


def df_rename_col(data: DataFrame, col: str, rename_to: str, destructive: bool = False) -> DataFrame:
    require(data, col)
    return data.toDF(*(rename_to if c == col else c for c in data.columns))


def df_rename_cols(data: DataFrame, exclude: str | None = None, prefix: str = "C", destructive: bool = False) -> DataFrame:
    """Columns named prefix0, prefix1, ...; the excluded one keeps its name and comes last."""
    kept = require(data, exclude) if exclude else []
    rest = [c for c in data.columns if c not in kept]
    return data.select(*(named(c).alias(f"{prefix}{i}") for i, c in enumerate(rest)), *(named(c) for c in kept))


def clean_name(name: str) -> str:
    """Lower case, runs of other characters than letters and digits as one underscore, none of them at the ends."""
    words = re.sub(r"[^0-9A-Za-z]+", " ", name).lower().replace(" ", "_")
    return words.removesuffix("_").removeprefix("_")


def df_clean_colnames(data: DataFrame, destructive: bool = False) -> DataFrame:
    names = [clean_name(c) for c in data.columns]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"several columns would be named {', '.join(twice)}")
    return data.toDF(*names)


def col_move_place(data: DataFrame, col: str | Sequence[str], position: str = "first", destructive: bool = False) -> DataFrame:
    """The columns first, each new one before the last, or (any other position) last."""
    moved = require(data, col)
    rest = [c for c in data.columns if c not in moved]
    order = [*reversed(moved), *rest] if position == "first" else [*rest, *moved]
    return _select(data, order)


def _select(data: DataFrame, names: Sequence[str]) -> DataFrame:
    return data.select(*(named(c) for c in names))


def df_restructure_values(data: DataFrame, structure: str = "list", destructive: bool = False) -> DataFrame:
    """Each cell bound to its column's name: an array, "name value", a map or a struct (structure list, str, dict, tuple)."""
    text = lambda c: named(c).cast("string")
    forms = {
        "list": lambda c: F.array(F.lit(c), text(c)),
        "str": lambda c: F.concat(F.lit(f"{c} "), F.coalesce(text(c), F.lit("nan"))),
        "dict": lambda c: F.create_map(F.lit(c), named(c)),
        "tuple": lambda c: F.struct(F.lit(c).alias("k"), text(c).alias("v")),
    }
    return with_columns(data, {c: forms[structure](c) for c in data.columns}) if structure in forms else data


def df_to_xy(data: DataFrame, y_col: str) -> tuple[DataFrame, DataFrame]:
    return df_drop_col(data, y_col), data.select(named(y_col))


def df_to_dfs(data: DataFrame, groupers: Sequence[str], y: str) -> dict[str, DataFrame]:
    """Per grouper, the columns whose name it matches (a regular expression), its text taken out of their names, and y last."""
    require(data, y)
    out = {}
    for g in groupers:
        hits = [c for c in data.columns if re.search(g, c)]
        out[g] = data.select(*(named(c).alias(c.replace(g, "")) for c in hits), named(y))
    return out


def col_to_split(data: DataFrame, col: str, col_names: Sequence[str] | None = None, sep: str = " ", destructive: bool = False) -> DataFrame:
    """A string column split at sep into columns named col_names, or col_a, col_b, ...; the column itself goes.

    The number of parts is that of col_names, else the largest found (one aggregate); rows with fewer get nulls.
    """
    name = require(data, col)[0]
    parts = F.split(named(name), re.escape(sep) if len(sep) == 1 else sep, -1)
    if col_names is None:
        width = data.agg(F.max(F.size(parts))).first()[0] or 0
        if width > 26:
            raise ValueError("more than 26 parts: give col_names")
        col_names = [f"{name}_{chr(97 + i)}" for i in range(width)]
    rest = [named(c) for c in data.columns if c != name]
    return data.select(*rest, *(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(col_names)))


def multi_input_support(X, data: DataFrame) -> DataFrame:
    """Columns by a name, names, a position, two positions (from, up to) or more positions."""
    names = data.columns
    if isinstance(X, int):
        picked = [names[X]]
    elif isinstance(X, str):
        picked = require(data, X)
    elif all(isinstance(x, int) for x in X):
        picked = names[X[0] : X[1]] if len(X) == 2 else [names[i] for i in X]
    else:
        picked = require(data, X)
    return _select(data, picked)


def transform_data(data: DataFrame, flatten: bool = False, X=False, Y=False):
    """The selected columns as floats: features, labels, or both; flatten gives one array column."""

    def floats(which):
        chosen = multi_input_support(which, data)
        cast = [named(c).cast("float").alias(c) for c in chosen.columns]
        return data.select(F.array(*cast).alias("values")) if flatten else data.select(*cast)

    found = [floats(w) for w in (X, Y) if w is not False]
    return found[0] if len(found) == 1 else tuple(found)


def datetime_detector(data: DataFrame) -> list[str]:
    return [f.name for f in data.schema if isinstance(f.dataType, TEMPORAL)]


def datetime_to_sequence(data: DataFrame, col: str, order_by: Sequence[str] = ()) -> DataFrame:
    """A timestamp column replaced by the rows' 0-based positions in its order, and placed first; order_by breaks ties."""
    numbered = number_rows(data, [col, *as_list(order_by)], "_position")
    renamed = with_columns(numbered, {col: F.col("_position")}).drop("_position")
    return col_move_place(renamed, col)


def datetime_handler(data: DataFrame, datetime_mode: str = "pass", order_by: Sequence[str] = ()) -> DataFrame:
    """pass: as it is; drop: without timestamps; sequence: positions in their order; retain: timestamps first."""
    found = datetime_detector(data)
    if datetime_mode == "pass" or not found:
        return data
    if datetime_mode == "drop":
        return df_drop_col(data, found)
    if datetime_mode == "retain":
        return col_move_place(data, found)
    if datetime_mode == "sequence":
        for c in found:
            data = datetime_to_sequence(data, c, order_by)
        return data
    raise ValueError(f"datetime_mode is pass, drop, sequence or retain, not {datetime_mode!r}")


def int_to_chars(data: DataFrame, col_name: str, out: str = "chars") -> DataFrame:
    """An integer column as arrays of its digits, padded with zeros to the longest (one aggregate)."""
    text = named(col_name).cast("string")
    width = data.agg(F.max(F.length(text))).first()[0] or 1
    return data.withColumn(out, F.split(F.lpad(text, width, "0"), "(?!$)"))


def is_text(data: DataFrame, name: str) -> bool:
    return isinstance(kind(data, name), T.StringType)
