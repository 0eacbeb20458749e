"""Sequences and tensors as array columns, the row axis being the frame's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from grainmill.functions.core import as_list, hash_order, named, number, number_rows, require


def array_reshape_conv1d(data: DataFrame, cols: str | Sequence[str], out: str = "x") -> DataFrame:
    """Columns (or one array column) of n features as an n x 1 array."""
    names = require(data, cols)
    flat = named(names[0]) if len(names) == 1 and dict(data.dtypes)[names[0]].startswith("array") else F.array(*(number(data, c) for c in names))
    return data.withColumn(out, F.transform(flat, lambda v: F.array(v.cast("double"))))


def _ratio(v: Column, by: Column) -> Column:
    """v / by as IEEE 754 has it, also by zero (0 / 0 is NaN, others are infinite); Spark's own division gives null or an error."""
    sign = F.signum(v) * F.when(by.cast("string") == "-0.0", -1.0).otherwise(1.0)
    by_zero = F.when(v == 0, F.lit(float("nan"))).otherwise(sign * float("inf"))
    return F.when(by == 0, F.when(v.isNotNull(), by_zero)).otherwise(v / F.when(by != 0, by))


#: Neighbouring rows that share a task when windows are made.
BLOCK_ROWS = 2_048


def sequence_windows(data: DataFrame, value: str, seq_len: int, order_by: str | Sequence[str], normalise_window: bool = False) -> DataFrame:
    """(idx, window): the N - (seq_len + 1) windows of seq_len + 1 values in order, each over its first value less 1 if normalised (NaN or infinite after a zero).

    Rows are dealt in blocks of neighbours; the first seq_len of a block go to the block before as well, so that each
    window lies in one task, and hardly a row travels twice.
    """
    length = seq_len + 1
    order = as_list(order_by)
    rows = number_rows(data.select(number(data, value).alias("v"), *(named(c).alias(f"o{i}") for i, c in enumerate(order))), [f"o{i}" for i in range(len(order))], "_rn").select("_rn", "v")
    n = data.count()
    size = max(BLOCK_ROWS, 4 * length)
    block = F.floor(F.col("_rn") / size)
    blocks = F.when((F.col("_rn") % size < seq_len) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    dealt = rows.select("_rn", "v", F.explode(blocks).alias("block"))
    made = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("_rn", "v"))).alias("w"))
    values, start = F.transform("w", lambda s: s["v"]), F.col("w")[0]["_rn"]
    made = made.select(start.alias("start"), values.alias("values"), F.least(F.lit(size), F.size("w"), n - length - start).cast("int").alias("own")).where("own > 0")
    made = made.select("start", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("own")), lambda i: F.slice("values", i, length))).alias("at", "w"))
    made, window = made.select((F.col("start") + F.col("at")).alias("idx"), "w"), F.col("w")
    if normalise_window:
        made = made.withColumn("w0", F.get(window, F.lit(0)))
        window = F.transform(window, lambda v: _ratio(v, F.col("w0")) - 1)
    return made.select("idx", window.alias("window"))


def array_reshape_lstm(data: DataFrame, value: str, seq_len: int, normalise_window: bool = False, order_by: str | Sequence[str] = (), seed: int = 0) -> DataFrame:
    """(idx, split, place, x, y): the first nine tenths of the windows are for training, at a random place; x is seq_len x 1, y the last value."""
    n = max(data.count() - seq_len - 1, 0)
    cut = round(0.9 * n)
    w = sequence_windows(data, value, seq_len, order_by, normalise_window)
    train = F.col("idx") < cut
    x = F.transform(F.slice("window", 1, seq_len), lambda v: F.array(v))
    return w.select("idx", F.when(train, "train").otherwise("test").alias("split"), F.when(train, hash_order(["idx"], seed)).otherwise(F.col("idx")).alias("place"), x.alias("x"), F.element_at("window", -1).alias("y"))


