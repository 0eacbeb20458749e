"""Time buckets over streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from grainmill.functions.core import as_list, named
from grainmill.operators.group import FREQUENCIES


def stream_resample_interval(data: DataFrame, x: str, dt_col: str, mode: str = "sum", freq: int | str = 60, watermark: str = "1 day", keys: str | Sequence[str] = ()) -> DataFrame:
    """x aggregated over intervals labelled by their right edge, for a streaming (or static) frame; only intervals with rows.

    keys: columns that each get their own series and stay in the result.
    State is bounded by the watermark: intervals that ended that long before the latest event are final and dropped.
    Watermarks want time-zone-aware timestamps, so others are cast.
    """
    makers = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "count": F.count, "std": F.stddev_samp}
    if mode not in makers:
        raise ValueError(f"mode is one of {', '.join(makers)}, not {mode!r}")
    seconds = int(FREQUENCIES.get(freq, freq) if isinstance(freq, str) else freq) * 60
    c: Column = named(x)
    clean = F.when(~F.isnan(c.cast("double")), c)
    timed = data.withColumn(dt_col, named(dt_col).cast("timestamp")).withWatermark(dt_col, watermark)
    own = [named(k) for k in as_list(keys)]
    made = timed.groupBy(*own, F.window(named(dt_col), f"{seconds} seconds").alias("_w")).agg(makers[mode](clean).alias(x))
    return made.select(*own, F.col("_w.end").alias(dt_col), named(x))
