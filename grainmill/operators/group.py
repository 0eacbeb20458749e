"""Grouped statistics: one aggregate per result, so one shuffle of pre-aggregated rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, GroupedData, Window, functions as F

from grainmill.functions.core import as_list, few_values, fit, hash_order, is_numeric, named, numeric_columns, number, present, require

#: Minutes of the named frequencies; a month has thirty days, or the 22.5 that the number 32400 stands for.
FREQUENCIES = {"quarter": 240, "half": 720, "full": 1440, "week": 10080, "month": 43200, "year": 525600}
SHORT_MONTH = 32400


def _rank(order_by: Sequence[str]) -> Column:
    return F.struct(*(named(c) for c in order_by))


def _first(x: Column, order_by: Sequence[str]) -> Column:
    return F.min_by(x, F.when(x.isNotNull(), _rank(order_by)))


def _last(x: Column, order_by: Sequence[str]) -> Column:
    return F.max_by(x, F.when(x.isNotNull(), _rank(order_by)))


def _entropy(x: Column) -> Column:
    """Shannon entropy in nats of the values normalised to sum 1, as ln S - sum(x ln x) / S: no second pass for S. Values that are not positive count as nothing."""
    v = F.when(x > 0, x.cast("double"))
    return F.ln(F.sum(v)) - F.sum(v * F.ln(v)) / F.sum(v)


def _strict_entropy(x: Column) -> Column:
    """The same by the bare formula, which has no value (NaN) for a group that holds a zero or a negative value."""
    return F.when(F.min(x) <= 0, F.lit(float("nan"))).otherwise(_entropy(x))


def _string(x: Column, order_by: Sequence[str]) -> Column:
    rows = F.sort_array(F.collect_list(F.when(x.isNotNull(), F.struct(_rank(order_by).alias("o"), x.cast("string").alias("x")))))
    return F.array_join(F.transform(rows, lambda r: r["x"]), " ")


#: name -> (aggregate of (column, order columns, seed), whether it is for numbers only, whether it needs an order)
AGGREGATES: dict[str, tuple[Callable, bool, bool]] = {
    "median": (lambda x, o, s: F.median(x), True, False),
    "mean": (lambda x, o, s: F.avg(x), True, False),
    "first": (lambda x, o, s: _first(x, o), False, True),
    "last": (lambda x, o, s: _last(x, o), False, True),
    "std": (lambda x, o, s: F.stddev_samp(x), True, False),
    "max": (lambda x, o, s: F.max(x), False, False),
    "min": (lambda x, o, s: F.min(x), False, False),
    "sum": (lambda x, o, s: F.coalesce(F.sum(x), F.lit(0)), True, False),
    "random": (lambda x, o, s: F.max_by(x, hash_order(o, s)), False, True),
    "freq": (lambda x, o, s: F.mode(x, True), False, False),
    "mode": (lambda x, o, s: F.mode(x, True), False, False),
    "string": (lambda x, o, s: _string(x, o), False, True),
    "entropy": (lambda x, o, s: _entropy(x), True, False),
    "strict_entropy": (lambda x, o, s: _strict_entropy(x), True, False),
}


def aggregate(data: DataFrame, name: str, func: str, order_by: Sequence[str] = (), seed: int = 0) -> Column:
    """The aggregate called func of a column, missing values left out."""
    if func not in AGGREGATES:
        raise ValueError(f"func is one of {', '.join(AGGREGATES)}, not {func!r}")
    make, _, ordered = AGGREGATES[func]
    if ordered and not order_by:
        raise ValueError(f"{func} depends on the order of rows: name it with order_by=")
    return make(present(data, name), list(order_by), seed)


def groupby_func(data: GroupedData, func: str | Callable, frame: DataFrame | None = None, cols: Sequence[str] | None = None, order_by: Sequence[str] = (), seed: int = 0, schema: str | None = None) -> DataFrame:
    """A grouped frame aggregated by a name of AGGREGATES, or by a function from one pandas frame to another (with schema)."""
    if callable(func):
        return data.applyInPandas(func, schema)
    return data.agg(*(aggregate(frame, c, func, order_by, seed).alias(c) for c in cols))


def df_to_groupby(data: DataFrame, by: str | Sequence[str], func: str | Callable, order_by: str | Sequence[str] = (), seed: int = 0, schema: str | None = None) -> DataFrame:
    """All other columns aggregated by group; functions of numbers leave out columns of other types, and the order columns stay out of ordered ones."""
    keys, order = require(data, by), as_list(order_by)
    grouped = data.groupBy(*(named(k) for k in keys))
    if callable(func):
        return groupby_func(grouped, func, schema=schema)
    numeric = AGGREGATES.get(func, (None, False, False))[1]
    cols = [c for c in data.columns if c not in keys and (not numeric or is_numeric(data, c))]
    return groupby_func(grouped, func, data, cols, order, seed)


def col_resample_interval(data: DataFrame, x: str, dt_col: str, mode: str = "first", freq: int | str = 60, order_by: str | Sequence[str] = (), fill: bool = True, short_month: bool = False, seed: int = 0) -> DataFrame:
    """x aggregated over intervals of freq minutes, closed left and labelled by their right edge, from the first day's midnight on.

    Empty intervals between the first and the last are filled in (null, or 0 for sum) unless fill is off.
    """
    minutes = SHORT_MONTH if freq == "month" and short_month else FREQUENCIES.get(freq, freq) if isinstance(freq, str) else freq
    width = int(minutes) * 60
    ts = named(dt_col)
    start = fit(data, {"s": F.unix_seconds(F.date_trunc("day", F.min(ts)).cast("timestamp"))})["s"]
    window = F.window(ts, f"{width} seconds", None, f"{(start or 0) % width} seconds")
    out = data.where(ts.isNotNull()).groupBy(window.alias("_w")).agg(aggregate(data, x, mode, as_list(order_by), seed).alias(x)).select(F.col("_w.end").alias(dt_col), named(x))
    if not fill:
        return out
    step = F.make_dt_interval(secs=F.lit(width))
    ends = out.agg(F.min(dt_col).alias("a"), F.max(dt_col).alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", step)).alias(dt_col))
    filled = ends.join(out, dt_col, "left")
    return filled.withColumn(x, F.coalesce(named(x), F.lit(0))) if mode == "sum" else filled


def col_groupby_stats(data: DataFrame, col: str, y: str) -> DataFrame:
    """std, mean, n and sum of y per value of col, rounded half to even at two places."""
    v = number(data, y)
    return data.groupBy(named(col)).agg(F.bround(F.stddev_samp(v), 2).alias("std"), F.bround(F.avg(v), 2).alias("mean"), F.count(v).alias("n"), F.bround(F.coalesce(F.sum(v), F.lit(0.0)), 2).alias("sum"))


def _survival(data: DataFrame, col: str, metric_col: str, name: str, ascending: bool, density: bool) -> DataFrame:
    counts = data.where(present(data, metric_col).isNotNull()).groupBy(named(col), present(data, metric_col).alias(metric_col)).agg(F.count("*").alias("_c"))
    group = Window.partitionBy(named(col))
    upto = group.orderBy(named(metric_col)).rowsBetween(Window.unboundedPreceding, 0)
    share = F.col("_c") / F.sum("_c").over(group) if density else 1 - F.sum("_c").over(upto) / F.sum("_c").over(group)
    return counts.select(named(col), named(metric_col), F.bround(share, 2).alias(name)).orderBy(named(metric_col).asc() if ascending else named(metric_col).desc())


def col_groupby_cdf(data: DataFrame, col: str, metric_col: str, ascending: bool = False) -> DataFrame:
    """Per group the share of rows above each metric value (the survival function), in a column CDF. Windows see one row per different value."""
    return _survival(data, col, metric_col, "CDF", ascending, False)


def col_groupby_pdf(data: DataFrame, col: str, metric_col: str, ascending: bool = False, kind: str = "survival") -> DataFrame:
    """The same numbers as CDF in a column PDF; kind='density' gives the share of rows at each value instead."""
    return _survival(data, col, metric_col, "PDF", ascending, kind == "density")


def col_corr_category(data: DataFrame, col: str, outcome: str, rounding: int = 2, warning_threshold: int = 40, with_n: bool = False) -> DataFrame:
    """The percentage of outcome per category; with_n adds the number of rows and `warning`, '**' below the threshold."""
    rows = data.where(present(data, col).isNotNull()).groupBy(named(col))
    n = F.count("*")
    rate = F.bround(F.coalesce(F.sum(number(data, outcome)), F.lit(0.0)) / n * 100, rounding).alias(outcome)
    return rows.agg(rate, n.alias("n"), F.when(n < warning_threshold, "**").otherwise("").alias("warning")) if with_n else rows.agg(rate)


def df_groupby_params(data: DataFrame, metric: str, dims: int = 4, gram_type: str = "ngram", group_by_func: str = "sum") -> DataFrame:
    """The metric aggregated by grams of parameters, largest first: (gram: array of (k, v), value).

    ngram: dims neighbouring columns; skipgram: any dims columns in order; flexgram: any 1 to dims columns; none: single ones.
    """
    names = [c for c in data.columns if c != metric]
    sizes = {"ngram": [dims], "skipgram": [dims], "flexgram": range(1, dims + 1), "none": [1]}[gram_type]
    picks = [tuple(range(i, i + dims)) for i in range(len(names) - dims + 1)] if gram_type == "ngram" else [p for k in sizes for p in combinations(range(len(names)), k)]
    cell = lambda i: F.struct(F.lit(names[i]).alias("k"), named(names[i]).cast("string").alias("v"))
    grams = F.array(*(F.array(*map(cell, p)) for p in picks))
    long = data.select(F.explode(grams).alias("gram"), named(metric).alias("value"))
    return long.groupBy("gram").agg(aggregate(long, "value", group_by_func).alias("value")).orderBy(F.desc("value"), "gram")


def df_print_values(data: DataFrame, n: int = 5, show: bool = False) -> DataFrame:
    """(column, value, count): the n most frequent values of each column, missing ones left out; ties by value."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), present(data, c).cast("string").alias("value")) for c in data.columns))
    counts = data.select(F.inline(cells)).where("value is not null").groupBy("column", "value").agg(F.count("*").alias("count"))
    top = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    out = counts.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= n).drop("_r")
    if show:
        out.orderBy("column", F.desc("count")).show(n * len(data.columns), truncate=False)
    return out


def col_to_cols(data: DataFrame, label_col: str, handler_col: str, with_metric: bool = False) -> DataFrame:
    """One row per (value column, handler), the labels, up to MOST_VALUES of them, as columns holding sums."""
    labels = few_values(data, label_col)
    values = numeric_columns(data, [label_col, handler_col])
    sums = [F.sum(F.when(named(label_col) == x, present(data, v))).alias(f"{i}_{j}") for i, v in enumerate(values) for j, x in enumerate(labels)]
    wide = data.groupBy(named(handler_col)).agg(*sums)
    rows = F.array(*(F.struct(F.lit(v).alias("metric"), *(F.col(f"{i}_{j}").cast("double").alias(str(x)) for j, x in enumerate(labels))) for i, v in enumerate(values)))
    out = wide.select(named(handler_col), F.inline(rows))
    return out if with_metric else out.drop("metric")


def grid_size(counts: Sequence[int]) -> int:
    return math.prod(counts)
