"""Correlations and feature importances."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from grainmill.functions.core import fit, is_numeric, n_unique, named, number, require, running_total, string_columns, with_columns
from grainmill.operators.forest import forest_importances


def average_ranks(data: DataFrame, name: str) -> DataFrame:
    """(_v, _r_name): the average rank of each different value, missing ones left out: the rows up to it less half of its ties."""
    counts = data.where(number(data, name).isNotNull()).groupBy(number(data, name).alias("_v")).agg(F.count("*").alias("_c"))
    total = running_total(counts, "_v", "_c", "_t")
    return total.select("_v", (F.col("_t") - (F.col("_c") - 1) / 2).alias(f"_r_{name}"))


def _spearman(data: DataFrame, pairs: Sequence[tuple[str, str]]) -> dict[tuple[str, str], float | None]:
    """Pearson's r of average ranks; a pair with missing values is ranked among its complete rows."""
    names = sorted({c for p in pairs for c in p})
    complete = fit(data, {"n": F.count(F.lit(1))} | {c: F.count(number(data, c)) for c in names})
    whole = [c for c in names if complete[c] == complete["n"]]
    out: dict[tuple[str, str], float | None] = {}
    batches = [([p for p in pairs if set(p) <= set(whole)], data)]
    batches += [([p], data.where(number(data, p[0]).isNotNull() & number(data, p[1]).isNotNull())) for p in pairs if not set(p) <= set(whole)]
    for batch, rows in batches:
        if not batch:
            continue
        ranked = rows
        for c in sorted({c for p in batch for c in p}):
            r = average_ranks(rows, c)
            ranked = ranked.join(r, number(rows, c) == F.col("_v"), "inner").drop("_v")
        got = fit(ranked, {f"{i}": F.corr(F.col(f"_r_{a}"), F.col(f"_r_{b}")) for i, (a, b) in enumerate(batch)})
        out |= {p: got[str(i)] for i, p in enumerate(batch)}
    return out


def pair_counter():
    """A function of rows (x, y, weight): the weight of the pairs that x and y order differently, ties in neither counted.

    Rows sorted by x, then y, are merge-sorted by y, all blocks of a width at once: O(n log² n) without a loop over rows.
    It is made here, not at the top of the module, so that Spark sends it whole to workers that cannot import this package.
    """

    def discordant(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> int:
        order = np.lexsort((y, x))
        n, found, width = len(order), 0, 1
        ranks = np.unique(y, return_inverse=True)[1].astype(np.int64)[order]
        weight = weight.astype(np.int64)[order]
        top = int(ranks.max(initial=0)) + 1
        while width < n:
            block, right = np.arange(n) // (2 * width), (np.arange(n) // width) % 2 == 1
            key = block * top + ranks
            left = key[~right]
            before = np.append(0, np.cumsum(weight[~right]))
            # Of each right row, the weight of the rows of its left neighbour block that have a greater y.
            greater = before[np.searchsorted(left, (block[right] + 1) * top, "left")] - before[np.searchsorted(left, key[right], "right")]
            found += int((weight[right] * greater).sum())
            order = np.argsort(key, kind="stable")
            ranks, weight = ranks[order], weight[order]
            width *= 2
        return found

    return discordant


#: Ranges a column is cut into at most: their cells, of which at most (2 * MOST_RANGES + 1) squared hold rows, come to the driver.
MOST_RANGES = 1000


def _kendall(data: DataFrame, pairs: Sequence[tuple[str, str]], range_rows: int) -> dict[tuple[str, str], float | None]:
    """Exact tau-b by ranges of both columns; no task sees more than the rows between two neighbouring quantiles.

    Even ranges lie between cuts, odd ones are single values, in which all is tied. A discordant pair has its rows in
    different ranges of both columns (counted from the cells' sizes), in one range of x (by a task per range), or in one
    range of y and different ones of x (again by a task per range). Equal rows are counted once, with their number.
    """
    names = sorted({c for p in pairs for c in p})
    most = max(fit(data, {c: F.count(number(data, c)) for c in names}), default=0)
    parts = min(MOST_RANGES, max(int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-most // range_rows), 2))
    got = fit(data, {c: F.percentile_approx(number(data, c), [i / parts for i in range(1, parts)], 10_000) for c in names})
    cuts = {c: F.lit(sorted(set(got[c]))).cast("array<double>") if got[c] else F.array().cast("array<double>") for c in names}
    return {(a, b): _tau_b(data.select(number(data, a).alias("x"), number(data, b).alias("y")), cuts[a], cuts[b]) for a, b in pairs}


def _tau_b(rows: DataFrame, x_cuts: Column, y_cuts: Column) -> float | None:
    side = lambda v, cuts: 2 * F.size(F.filter(cuts, lambda c: c < F.col(v))) + F.array_contains(cuts, F.col(v)).cast("int")
    points = rows.where("x is not null and y is not null").groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    cells = points.select("x", "y", "c", side("x", x_cuts).alias("i"), side("y", y_cuts).alias("j"))
    discordant, total = pair_counter(), lambda v: F.coalesce(F.sum(v.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    twice = total(F.col("c").cast("decimal(19,0)") * (F.col("c").cast("decimal(19,0)") - 1))
    count = lambda x: lambda p: pd.DataFrame({"v": [discordant(p[x].to_numpy(), p["y"].to_numpy(), p["c"].to_numpy())]})
    one_x = cells.where("i % 2 = 0").groupBy("i").applyInPandas(count("x"), "v bigint")
    one_y = cells.where("j % 2 = 0").groupBy("i", "j", "y").agg(F.sum("c").alias("c")).groupBy("j").applyInPandas(count("i"), "v bigint")
    scalars = {
        "n": points.agg(total(F.col("c")).alias("v")),
        "xy": points.agg(twice.alias("v")),
        "x": points.groupBy("x").agg(F.sum("c").alias("c")).agg(twice.alias("v")),
        "y": points.groupBy("y").agg(F.sum("c").alias("c")).agg(twice.alias("v")),
        "one_x": one_x.agg(total(F.col("v")).alias("v")),
        "one_y": one_y.agg(total(F.col("v")).alias("v")),
    }
    parts = [part.select(F.lit(name).alias("what"), F.lit(0).alias("i"), F.lit(0).alias("j"), "v") for name, part in scalars.items()]
    parts.append(cells.groupBy("i", "j").agg(total(F.col("c")).alias("v")).select(F.lit("cell").alias("what"), "i", "j", "v"))
    found, grid = {}, {}
    for what, i, j, v in reduce(DataFrame.unionByName, parts).collect():
        if what == "cell":
            grid[(i, j)] = int(v)
        else:
            found[what] = int(v)
    swaps = found["one_x"] + found["one_y"] + _cell_pairs(grid)
    n, tx, ty, both = found["n"] * (found["n"] - 1) // 2, found["x"] // 2, found["y"] // 2, found["xy"] // 2
    rest = (n - tx) * (n - ty)
    return float((n - tx - ty + both - 2 * swaps) / math.sqrt(rest)) if rest > 0 else None


def _cell_pairs(grid: dict[tuple[int, int], int]) -> int:
    """Pairs of rows of which one lies in a smaller range of x and a greater range of y than the other."""
    high = max((j for _, j in grid), default=0) + 1
    above, found = np.zeros(high + 1, object), 0  # rows of smaller ranges of x in a range of y or a greater one; Python's integers do not overflow
    for _, cells in groupby(sorted(grid.items()), lambda c: c[0][0]):
        here = np.zeros(high + 1, object)
        for (_, j), n in cells:
            found += n * above[j + 1]
            here[j] = n
        above += np.cumsum(here[::-1])[::-1]
    return found


def correlations(data: DataFrame, pairs: Sequence[tuple[str, str]], method: str = "pearson", range_rows: int = 1_000_000) -> dict[tuple[str, str], float | None]:
    if method == "pearson":
        got = fit(data, {str(i): F.corr(*_pair(data, a, b)) for i, (a, b) in enumerate(pairs)}) if pairs else {}
        return {p: got[str(i)] for i, p in enumerate(pairs)}
    if method == "spearman":
        return _spearman(data, pairs)
    if method == "kendall":
        return _kendall(data, pairs, range_rows)
    raise ValueError(f"method is pearson, spearman or kendall, not {method!r}")


def _pair(data: DataFrame, a: str, b: str) -> tuple[Column, Column]:
    return number(data, a), number(data, b)


def correlation_with(data: DataFrame, y: str, names: Sequence[str], method: str = "pearson") -> dict[str, float | None]:
    got = correlations(data, [(c, y) for c in names if c != y], method)
    return {c: 1.0 if c == y else got[(c, y)] for c in names}


def df_corr_any(data: DataFrame, correlation: str = "pearson", range_rows: int = 1_000_000) -> DataFrame:
    """(column, one double column per numeric column): the matrix over complete pairs, columns that are no numbers left out.

    range_rows: rows that a task of Kendall's tau is meant to take; more rows make more ranges, up to MOST_RANGES.
    """
    names = [c for c in data.columns if is_numeric(data, c)]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    r = correlations(data, pairs, correlation, range_rows)
    rows = [(a, *(r.get((a, b), r.get((b, a))) for b in names)) for a in names]
    schema = ", ".join(["column string", *(f"`{c}` double" for c in names)])
    return data.sparkSession.createDataFrame(rows, schema)


def df_corr_pearson(data: DataFrame, y: str, excluded_list: bool = False):
    """(column, corr, n_unique) for every column but y, null for those that are no numbers; with excluded_list also the names of those."""
    require(data, y)
    names = [c for c in data.columns if c != y]
    numeric = [c for c in names if is_numeric(data, c)]
    aggregates = {f"r{i}": F.corr(number(data, c), number(data, y)) for i, c in enumerate(names) if c in numeric}
    got = fit(data, aggregates | {f"u{i}": n_unique(data, c) for i, c in enumerate(names)})
    rows = [(c, got[f"r{i}"] if c in numeric else None, got[f"u{i}"]) for i, c in enumerate(names)]
    out = data.sparkSession.createDataFrame(rows, "column string, corr double, n_unique bigint")
    return (out, [c for c in names if c not in numeric]) if excluded_list else out


def _ordinals(data: DataFrame, x: str, y: str) -> DataFrame:
    """(x, label): categories ranked from 1 by the mean of y, which is their coefficient in a regression on indicators alone."""
    means = data.where(named(x).isNotNull()).groupBy(named(x).alias("_x")).agg(F.avg(number(data, y)).alias("_m"))
    return means.select("_x", F.dense_rank().over(Window.orderBy("_m")).alias("_label"))


def col_corr_ols(data: DataFrame, x: str, y: str, destructive: bool = False) -> DataFrame:
    """Categories replaced by integers: the larger, the larger the category's least-squares coefficient for y; missing stay missing."""
    require(data, [x, y])
    met = data.join(_ordinals(data, x, y), named(x) == F.col("_x"), "left").drop("_x")
    return with_columns(met, {x: F.col("_label")}).drop("_label")


def df_corr_ols(data: DataFrame, y: str, destructive: bool = False) -> DataFrame:
    """The same for every string column but y."""
    out = data
    for c in string_columns(data):
        if c != y:
            out = col_corr_ols(out, c, y)
    return out.select(*(named(c) for c in data.columns))


def _importances(data: DataFrame, y: str, classes: int, seed: int) -> DataFrame:
    names = [c for c in data.columns if c != y and is_numeric(data, c)]
    rows = data.select(*(number(data, c).alias(f"f{i}") for i, c in enumerate(names)), number(data, y).alias("label")).na.drop()
    found = forest_importances(rows, len(names), classes, seed=seed)
    return data.sparkSession.createDataFrame(list(zip(names, found, strict=True)), "column string, importance double").orderBy(F.desc("importance"), "column")


def df_corr_randomforest(data: DataFrame, y: str, destructive: bool = True, seed: int = 0) -> DataFrame:
    """Importances of the numeric columns in a regression forest of 100 trees of depth 3, largest first."""
    return _importances(data, y, 0, seed)


def df_corr_extratrees(data: DataFrame, y: str, seed: int = 0) -> DataFrame:
    """Importances in 100 extremely randomised classification trees of depth 3, largest first; random cuts fall between 32 bins of a column.

    Labels, 1000 at most, are numbered by rank first.
    """
    values = [r[0] for r in data.select(number(data, y)).na.drop().distinct().orderBy(number(data, y)).limit(1001).collect()]
    if len(values) > 1000:
        raise ValueError(f"{y} has more than 1000 classes")
    coded = with_columns(data, {y: F.array_position(F.lit(values).cast("array<double>"), number(data, y)).cast("double") - 1})
    return _importances(coded, y, max(len(values), 1), seed)
