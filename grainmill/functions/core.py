"""What the operators share: names, missing values, one-pass fitting, and row numbers that scale."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Row, Window, functions as F, types as T

NUMERIC = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
FLOATING = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def named(name: str) -> Column:
    """A column by its exact name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_list(names: str | Iterable[str] | None) -> list[str]:
    return [] if names is None else [names] if isinstance(names, str) else list(names)


def require(data: DataFrame, names: str | Iterable[str]) -> list[str]:
    names = as_list(names)
    if absent := [n for n in names if n not in data.columns]:
        raise KeyError(f"no such column: {', '.join(absent)}")
    return names


def kind(data: DataFrame, name: str) -> T.DataType:
    require(data, name)
    return data.schema[name].dataType


def is_numeric(data: DataFrame, name: str) -> bool:
    return isinstance(kind(data, name), (*NUMERIC, T.ShortType, T.ByteType, T.DecimalType))


def numeric_columns(data: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """int, bigint, float and double columns."""
    return [f.name for f in data.schema if isinstance(f.dataType, NUMERIC) and f.name not in set(exclude)]


def string_columns(data: DataFrame) -> list[str]:
    return [f.name for f in data.schema if isinstance(f.dataType, T.StringType)]


def present(data: DataFrame, name: str) -> Column:
    """The column with NaN read as NULL: both are missing."""
    c = named(name)
    return F.when(~F.isnan(c), c) if isinstance(kind(data, name), FLOATING) else c


def number(data: DataFrame, name: str) -> Column:
    return present(data, name).cast("double")


def with_columns(data: DataFrame, new: dict[str, Column]) -> DataFrame:
    """data with columns replaced in place or appended, in one projection."""
    kept = [new[c].alias(c) if c in new else named(c) for c in data.columns]
    return data.select(*kept, *(v.alias(k) for k, v in new.items() if k not in data.columns))


def fit(data: DataFrame, aggregates: dict[str, Column]) -> Row:
    """All the scalars an operator needs, in one pass."""
    return data.agg(*(v.alias(k) for k, v in aggregates.items())).first()


def n_unique(data: DataFrame, name: str) -> Column:
    """Number of different values; missing ones count as one value."""
    c = present(data, name)
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))


def unique_counts(data: DataFrame, names: Sequence[str]) -> dict[str, int]:
    return fit(data, {c: n_unique(data, c) for c in names}).asDict() if names else {}


def categories(data: DataFrame, names: Sequence[str]) -> dict[str, list]:
    """The sorted values of each column without missing ones, collected in one pass; for columns whose values were counted and are few."""
    if not names:
        return {}
    row = fit(data, {c: F.sort_array(F.collect_set(present(data, c))) for c in names})
    return {c: row[c] for c in names}


#: Different values of a column that may come to the driver and into a plan. More are an error: a code or a column for each is no use then.
MOST_VALUES = 10_000


def few_values(data: DataFrame, name: str, most: int = MOST_VALUES) -> list:
    """The sorted values of a column without missing ones; an error beyond `most`, of which no task or driver holds more."""
    values = data.select(present(data, name).alias("v")).where("v is not null").distinct().orderBy("v").limit(most + 1).collect()
    if len(values) > most:
        raise ValueError(f"{name} has more than {most} different values")
    return [r["v"] for r in values]


def code(data: DataFrame, name: str, values: Sequence) -> Column:
    """The position of the value among the sorted values, -1 if missing."""
    if not values:
        return F.lit(-1)
    known = F.lit(list(values)).cast(T.ArrayType(kind(data, name)))
    return F.coalesce(F.array_position(known, present(data, name)).cast("int") - 1, F.lit(-1))


def number_rows(data: DataFrame, order_by: str | Sequence[str], name: str) -> DataFrame:
    """data with a dense 0-based row number in the order of order_by, as bigint.

    A window without partitions would send all rows to one task. Instead the first order column is
    cut at its approximate quantiles (literals, so every task and every rerun agrees), rows are
    numbered within each range, and the counts of the ranges before give the offsets. Strings are
    cut at values of a sample; only other types fall back to one window.
    """
    order = require(data, order_by)
    full = [named(c).asc_nulls_first() for c in order]
    ranged = _ranged(data, order[0])
    if ranged is None:
        return data.withColumn(name, F.row_number().over(Window.orderBy(*full)).cast("bigint") - 1)
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*full)) - 1
    return ranged.withColumn(name, local + _before(ranged, F.count(F.lit(1)))).drop("_range")


def running_total(data: DataFrame, order_by: str, amount: str, name: str) -> DataFrame:
    """data with the running total of a whole-number column in the order of a numeric column of different values, by the same ranges."""
    ranged = _ranged(data, order_by)
    window = Window.partitionBy("_range").orderBy(named(order_by)).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn(name, F.sum(named(amount)).over(window) + _before(ranged, F.sum(named(amount)))).drop("_range")


def _ranged(data: DataFrame, lead: str) -> DataFrame | None:
    """data with `_range`, the number of the quantile range of its lead column; None if that has no quantiles."""
    parts = max(2, int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if isinstance(kind(data, lead), T.StringType):
        return data.withColumn("_range", _range_of(named(lead), F.lit(_string_cuts(data, lead, parts)).cast("array<string>")))
    if not isinstance(kind(data, lead), (*NUMERIC, *TEMPORAL)):
        return None
    key = present(data, lead) if isinstance(kind(data, lead), NUMERIC) else _micros(data, lead)
    cuts = fit(data, {"q": F.percentile_approx(key, [i / parts for i in range(1, parts)], 10_000)})["q"] or []
    cuts = F.lit(sorted(set(cuts))).cast("array<double>" if isinstance(kind(data, lead), FLOATING) else "array<bigint>") if cuts else F.array().cast("array<bigint>")
    return data.withColumn("_range", _range_of(key, cuts))


def _range_of(key: Column, cuts: Column) -> Column:
    return F.when(key.isNull(), F.lit(0)).otherwise(F.size(F.filter(cuts, lambda c: c < key)))


def _string_cuts(data: DataFrame, name: str, parts: int) -> list[str]:
    """Up to parts - 1 values that cut a string column into ranges of about as many rows: quantiles of the values whose
    hash falls into a share of all, some 100 a range, each with its number of rows. Any cuts give right numbers."""
    n = data.where(named(name).isNotNull()).count()
    share = max(n // (100 * parts), 1)
    sample = data.where(named(name).isNotNull() & (F.pmod(F.xxhash64(named(name)), F.lit(share)) == 0))
    counts = sample.groupBy(named(name).alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy("v").collect()
    step, seen, cuts = sum(r["n"] for r in counts) / parts, 0, []
    for r in counts[:-1]:
        seen += r["n"]
        if seen >= step * (len(cuts) + 1) and len(cuts) < parts - 1:
            cuts.append(r["v"])
    return cuts


def _before(ranged: DataFrame, amount: Column) -> Column:
    """What the ranges before a row's hold altogether: one row a range comes to the driver."""
    before, offset = [], 0
    for r in ranged.groupBy("_range").agg(amount.alias("n")).orderBy("_range").collect():
        before += [F.lit(r["_range"]), F.lit(offset).cast("bigint")]
        offset += int(r["n"])
    return F.create_map(*before)[F.col("_range")] if before else F.lit(0).cast("bigint")


def _micros(data: DataFrame, name: str) -> Column:
    return F.unix_micros(named(name).cast("timestamp"))


def hash_order(keys: Sequence[str], seed: int) -> Column:
    """A reproducible random number per row, from the row's key: unlike rand(), it survives repartitioning."""
    return F.xxhash64(F.lit(seed), *(named(k) for k in keys))


#: How far from a quantile its bracket reaches, as a share of the rows: twice the error of percentile_approx.
SLACK = 2e-4


def quantiles(data: DataFrame, wanted: dict[str, Sequence[float]]) -> dict[str, list[float] | None]:
    """Exact quantiles of columns, interpolated as percentile() does, missing values left out; None for a column without values.

    percentile() sends every different value of a column to one task. Here approximate quantiles bracket the rows in question;
    those below are counted, and only the different values within, some four ten-thousandths of the rows at most, come to the driver.
    """
    n = fit(data, {f"n{i}": F.count(number(data, c)) for i, c in enumerate(wanted)}) if wanted else {}
    counts = {c: n[f"n{i}"] for i, c in enumerate(wanted)}
    found: dict[tuple[str, float], float] = {}
    todo, widen = [(c, p) for c, ps in wanted.items() for p in ps if counts[c]], 1
    while todo:
        slack = [max(SLACK, 2 / counts[c]) * widen for c, _ in todo]
        near = fit(data, {f"q{i}": F.percentile_approx(number(data, c), [max(p - s, 0.0), min(p + s, 1.0)], 10_000) for i, ((c, p), s) in enumerate(zip(todo, slack, strict=True))})
        cells = []
        for i, (c, _) in enumerate(todo):
            x, (low, high) = number(data, c), near[f"q{i}"]
            cells.append(F.when(x <= high, F.struct(F.lit(i).alias("i"), F.when(x >= low, x).alias("v"))))
        held = data.select(F.explode(F.array(*cells)).alias("s")).where("s is not null").groupBy("s.i", "s.v").agg(F.count(F.lit(1)).alias("n"))
        values: dict[int, list] = {i: [] for i in range(len(todo))}
        for r in held.collect():
            values[r["i"]].append((r["v"], r["n"]))
        missed = []
        for i, (c, p) in enumerate(todo):
            at = p * (counts[c] - 1)
            low, high = (_at_rank(values[i], k) for k in (math.floor(at), math.ceil(at)))
            if low is None or high is None:
                missed.append((c, p))
            else:
                found[(c, p)] = low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high
        todo, widen = missed, widen * 10
    return {c: [found[(c, p)] for p in ps] if counts[c] else None for c, ps in wanted.items()}


def _at_rank(values: list, rank: int) -> float | None:
    """The value at a 0-based rank of (value, rows) pairs, of which the one without a value counts those below; None if it is not among them."""
    seen = sum(n for v, n in values if v is None)
    if rank < seen:
        return None
    for v, n in sorted((v, n) for v, n in values if v is not None):
        seen += n
        if rank < seen:
            return v
    return None


def modes(data: DataFrame, names: Sequence[str]) -> dict[str, float | None]:
    """The most frequent number of each column, the smallest of several, missing ones left out: values are counted side by side, as
    mode() would send all of a column's different ones to one task."""
    cells = F.array(*(F.struct(F.lit(i).alias("i"), number(data, c).alias("v")) for i, c in enumerate(names)))
    counts = data.select(F.inline(cells)).where("v is not null").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    best = {r["i"]: r["v"] for r in counts.groupBy("i").agg(F.max_by("v", F.struct("n", (-F.col("v")).alias("v"))).alias("v")).collect()} if names else {}
    return {c: best.get(i) for i, c in enumerate(names)}
