"""Sampling, shuffling, splitting and folding.

A random order is the hash of a row's key and the seed: it does not change when the data is
repartitioned or a task is run again. Give `key` the columns that identify a row; without it all
columns do, and equal rows share a place in the order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from grainmill.functions.core import MOST_VALUES, as_list, hash_order, named, number_rows, require


def _order(data: DataFrame, key: str | Sequence[str] | None, seed: int) -> Column:
    return hash_order(as_list(key) or data.columns, seed)


def shuffled_rows(data: DataFrame, name: str, key: str | Sequence[str] | None = None, seed: int = 0) -> DataFrame:
    """data with the 0-based place of each row in a random order."""
    keys = as_list(key) or data.columns
    placed = data.withColumn("_h", hash_order(keys, seed))
    return number_rows(placed, ["_h", *keys], name).drop("_h")


def array_random_shuffle(x: DataFrame, y: str | None = None, multi_input: bool = False, key: str | Sequence[str] | None = None, seed: int = 0) -> DataFrame:
    """The rows in a random order; features and labels that are columns of one frame stay paired."""
    return x.withColumn("_h", _order(x, key, seed)).orderBy("_h").drop("_h")


def _positions(data: DataFrame, order_by, is_shuffled: bool, key, seed: int) -> DataFrame:
    if is_shuffled:
        return shuffled_rows(data, "_rn", key, seed)
    if not order_by:
        raise ValueError("without shuffling, name the order of rows with order_by=")
    return number_rows(data, order_by, "_rn")


def array_split(data: DataFrame, split: float, shuffled: bool = True, order_by: str | Sequence[str] = (), key: str | Sequence[str] | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(training, validation): exactly int(n * (1 - split)) rows, and the others."""
    limit = int(data.count() * (1 - split))
    placed = _positions(data, order_by, shuffled, key, seed)
    return placed.where(F.col("_rn") < limit).drop("_rn"), placed.where(F.col("_rn") >= limit).drop("_rn")


def array_to_kfold(data: DataFrame, folds: int = 10, shuffled: bool = True, order_by: str | Sequence[str] = (), key: str | Sequence[str] | None = None, seed: int = 0, out: str = "fold") -> DataFrame:
    """data with the fold of each row, folds of int(n / folds) neighbouring rows; the remainder is left out."""
    step = data.count() // folds
    placed = _positions(data, order_by, shuffled, key, seed)
    fold = F.floor(F.col("_rn") / max(step, 1)).cast("int")
    return placed.withColumn(out, fold).where((F.col(out) < folds) & F.lit(step > 0)).drop("_rn")


def batches(data: DataFrame, batch_size: int, order_by: str | Sequence[str], out: str = "batch_id") -> DataFrame:
    """data with the number of its batch: batch_size rows in order, the last batch maybe fewer."""
    return number_rows(data, order_by, "_rn").withColumn(out, F.floor(F.col("_rn") / batch_size).cast("bigint")).drop("_rn")


def array_to_generator(data: DataFrame, x: Sequence[str], y: str, batch_size: int, order_by: str | Sequence[str], endless: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of float32 features and labels, again and again; one partition at a time is on the driver."""
    require(data, [*x, y])
    rows = data.orderBy(*(named(c) for c in as_list(order_by))).select(*(named(c).cast("float").alias(c) for c in x), named(y).cast("float").alias(y))
    while True:
        held: list = []
        for r in rows.toLocalIterator(prefetchPartitions=True):
            held.append(r)
            if len(held) == batch_size:
                yield _as_batch(held)
                held = []
        if held:
            yield _as_batch(held)
        if not endless:
            return


def _as_batch(rows: list) -> tuple[np.ndarray, np.ndarray]:
    table = np.array(rows, np.float32)
    return table[:, :-1], table[:, -1]


def array_random_weighted(data: DataFrame, x: str, weights: str | Sequence[float], size: int, seed: int = 0) -> DataFrame:
    """size draws with replacement from the values of x: (draw, x).

    weights: a column of the frame; probabilities in the order of x; or normal, poisson or laplace for weights from a
    Dirichlet distribution whose parameters are ten plus such numbers. The frame has up to MOST_VALUES rows, else it is an
    error; draws are made by tasks, each from the hash of its number and the seed.
    """
    rng = np.random.default_rng(seed)
    of_column = isinstance(weights, str) and weights not in ("normal", "poisson", "laplace")
    found = data.select(named(x).alias("x"), (named(weights) if of_column else F.lit(0)).cast("double").alias("w")).orderBy("x").limit(MOST_VALUES + 1).collect()
    if len(found) > MOST_VALUES:
        raise ValueError(f"there are more than {MOST_VALUES} values to draw from")
    values = [r["x"] for r in found]
    if of_column:
        p = np.array([r["w"] for r in found], float)
    elif isinstance(weights, str):
        p = rng.dirichlet(np.maximum(getattr(rng, weights)(size=len(values)) + 10, 1e-3))
    else:
        p = np.asarray(weights, float)
    if len(p) != len(values) or (p < 0).any() or not p.sum():
        raise ValueError("weights are as many as values, none negative, not all 0")
    ends = np.cumsum(p / p.sum())
    ends[-1] = 1.0
    spark = data.sparkSession
    kind = data.schema[x].dataType
    known = F.lit(values).cast(T.ArrayType(kind))
    bounds = F.lit(ends.tolist()).cast("array<double>")
    part = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 53))
    u = spark.range(size).select(F.col("id").alias("draw"), (part / float(1 << 53)).alias("u"))
    at = F.size(F.filter(bounds, lambda b: b <= F.col("u")))
    return u.select("draw", F.get(known, at).alias(x))


def _ranked(data: DataFrame, col: str, key, seed: int) -> Column:
    keys = as_list(key) or data.columns
    return F.row_number().over(Window.partitionBy(named(col)).orderBy(hash_order(keys, seed), *(named(k) for k in keys)))


def _top_per_class(data: DataFrame, col: str, n: int, key, seed: int) -> DataFrame:
    """n rows of each class in hash order; the rank filter lets Spark cut each task's rows before the shuffle."""
    return data.where(named(col).isNotNull()).withColumn("_r", _ranked(data, col, key, seed)).where(F.col("_r") <= n).drop("_r")


def col_resample_equal(data: DataFrame, col: str, sample_size: int, key: str | Sequence[str] | None = None, seed: int = 0) -> DataFrame:
    """Exactly sample_size rows of each class; a smaller class is an error."""
    least = data.where(named(col).isNotNull()).groupBy(named(col)).count().agg(F.min("count")).first()[0]
    if least is not None and least < sample_size:
        raise ValueError(f"the smallest class has {least} rows, fewer than {sample_size}")
    return _top_per_class(data, col, sample_size, key, seed)


def df_resample_stratified(data: DataFrame, strat_col: str, n: int | None = None, destructive: bool = False, key: str | Sequence[str] | None = None, seed: int = 0) -> DataFrame:
    """Up to n rows of each class; by default as many as the smallest has."""
    if n is None:
        n = data.where(named(strat_col).isNotNull()).groupBy(named(strat_col)).count().agg(F.min("count")).first()[0] or 0
    return _top_per_class(data, strat_col, n, key, seed)


def df_resample_id(data: DataFrame, id_col: str, n: int | None = None, destructive: bool = False, order_by: str | Sequence[str] = (), seed: int = 0) -> DataFrame:
    """The first row of each id in the order given, n of them at random (all by default)."""
    order = as_list(order_by) or [c for c in data.columns if c != id_col]
    first = Window.partitionBy(named(id_col)).orderBy(*(named(c) for c in order))
    out = data.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    out = out.withColumn("_h", hash_order([id_col], seed)).orderBy("_h")
    return (out if n is None else out.limit(n)).drop("_h")

