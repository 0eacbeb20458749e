"""Row and column dropping, predicates, duplicates and missing-value profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from grainmill.functions.core import as_list, named, fit, is_numeric, n_unique, number, present, quantiles, require, string_columns, with_columns
from grainmill.operators.columns import df_drop_col

#: How the two numeric parsers differ is settled by this pattern: optional sign, digits with single
#: underscores between them, fraction, exponent, or nan/inf.
NUMBER = r"(?i)^\s*[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?\s*$|^\s*[+-]?(nan|inf|infinity)\s*$"


def col_drop_outliers(data: DataFrame, col: str, mode: str = "zscore", threshold: float = 3, destructive: bool = False) -> DataFrame:
    """Rows without a missing value whose value is no outlier: |z| < threshold with the population deviation, or below IQR * threshold.

    The statistics are scalars; as literals they let the filter reach the scan.
    """
    x = number(data, col)
    kept = data.where(present(data, col).isNotNull())
    if mode == "zscore":
        s = fit(data, {"m": F.avg(x), "sd": F.stddev_pop(x)})
        if not s["sd"]:
            return kept.limit(0)
        return kept.where((x - s["m"]) / s["sd"] > -threshold).where((x - s["m"]) / s["sd"] < threshold)
    if mode == "iqr":
        q = quantiles(data, {col: [0.25, 0.75]})[col]
        return kept.where(x < (q[1] - q[0]) * threshold) if q else kept
    raise ValueError(f"mode is zscore or iqr, not {mode!r}")


def df_drop_nanrows(data: DataFrame, destructive: bool = False) -> DataFrame:
    return data.na.drop("any")


def _shares(data: DataFrame) -> dict[str, float]:
    row = fit(data, {"_n": F.count(F.lit(1))} | {c: F.count(present(data, c)) for c in data.columns})
    return {c: (row[c] / row["_n"] if row["_n"] else 1.0) for c in data.columns}


def df_drop_nancols(data: DataFrame, threshold: float = 0, max_nan_fraction: float | None = None, destructive: bool = False) -> DataFrame:
    """Columns of which at least `threshold` of the values are present; or, with max_nan_fraction, at most that share missing."""
    least = threshold if max_nan_fraction is None else 1 - max_nan_fraction
    return data.select(*(named(c) for c, share in _shares(data).items() if share >= least))


def nan_dropper(data: DataFrame, treshold: float = 0.9) -> DataFrame:
    """First columns with too few values, then rows with missing ones."""
    return df_drop_nanrows(df_drop_nancols(data, treshold))


def df_drop_weak(data: DataFrame, y: str, min_correlation: float = 0.2, method: str = "pearson", drop_object: bool = True, destructive: bool = False, order_by: Sequence[str] = ()) -> DataFrame:
    """Columns whose correlation with y is at least min_correlation in size, or undefined; strings go if drop_object."""
    from grainmill.operators.corr import correlation_with

    gone = string_columns(data) if drop_object else []
    names = [c for c in data.columns if c not in gone and is_numeric(data, c)]
    r = correlation_with(data, y, names, method)
    weak = [c for c in names if r[c] is not None and abs(r[c]) < min_correlation]
    return df_drop_col(data, [*gone, *weak])


def df_drop_duplicates(data: DataFrame) -> DataFrame:
    return data.dropDuplicates()


def col_check_allsame(data: DataFrame, col: str) -> bool:
    """Whether the column has exactly one value; missing counts as one, and an empty column has none."""
    return fit(data, {"n": n_unique(data, col)})["n"] == 1


def is_number(value: Column | object) -> Column | bool:
    """Whether a string column's values, or a value, parse as a number; null is none."""
    if not isinstance(value, Column):
        try:
            float(value)
        except (TypeError, ValueError):
            return False
        return True
    return F.coalesce(value.cast("string").rlike(NUMBER), F.lit(False))


def string_contains_to_binary(data: DataFrame, col_that_contains: str, col_contains_strings: Sequence[str]) -> DataFrame:
    """One 0/1 double column per pattern, named by it: whether the regular expression is found."""
    require(data, col_that_contains)
    return with_columns(data, {p: F.coalesce(named(col_that_contains).rlike(p), F.lit(False)).cast("double") for p in as_list(col_contains_strings)})


def max_category(data: DataFrame, max_categories: int | str | None) -> int:
    """'auto': a fiftieth of the rows; 'max' or None: more than there are rows; a number: itself."""
    if isinstance(max_categories, int):
        return max_categories
    n = data.count()
    return n // 50 if max_categories == "auto" else n + 1


def df_count_uniques(data: DataFrame, approximate: bool = False) -> DataFrame:
    """(column, n_unique): different values per column, missing counting as one; one pass."""
    count = (lambda c: F.approx_count_distinct(present(data, c)) + F.max(present(data, c).isNull().cast("int"))) if approximate else (lambda c: n_unique(data, c))
    return _long(data.agg(*(count(c).cast("bigint").alias(f"c{i}") for i, c in enumerate(data.columns))), data.columns, "n_unique", 1)


def _long(row: DataFrame, names: Sequence[str], value: str, width: int) -> DataFrame:
    """A one-row frame of c0, c1, ... as (column, value) rows."""
    entries = F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"c{i}"), F.lit(0).cast("bigint")).alias(value)) for i, c in enumerate(names)))
    return row.select(F.inline(entries))


def df_find_nan(data: DataFrame) -> DataFrame:
    """(column, no_nans, quality): whether a column is all present or all missing, and its share of values present; one pass."""
    row = data.agg(F.count(F.lit(1)).alias("n"), *(F.count(present(data, c)).alias(f"c{i}") for i, c in enumerate(data.columns)))
    entries = F.array(*(F.struct(F.lit(c).alias("column"), ((F.col(f"c{i}") == 0) | (F.col(f"c{i}") == F.col("n"))).alias("no_nans"), F.try_divide(F.col(f"c{i}"), F.col("n")).alias("quality")) for i, c in enumerate(data.columns)))
    return row.select(F.inline(entries))
