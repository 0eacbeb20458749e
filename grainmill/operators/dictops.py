"""Operators on dictionaries: of frames that are analysed together, and of parameter lists."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, functions as F

from grainmill.functions.core import fit, number, present
from grainmill.operators.transform import buckets


def dic_corr_perc(data: dict[str, DataFrame], y: str, cuts: int = 5) -> DataFrame:
    """(bucket, y, samples, metric, metric_context): in each frame, per numeric column but y and bucket of its range, the
    percentage of y and the number of rows. Two passes a frame: one for all ranges, one for everything else."""
    out = None
    for context, frame in data.items():
        names = [f.name for f in frame.schema if f.name != y and f.dataType.simpleString() in ("int", "bigint", "float", "double")]
        if not names:
            continue
        ends = fit(frame, {f"a{i}": F.min(number(frame, c)) for i, c in enumerate(names)} | {f"b{i}": F.max(number(frame, c)) for i, c in enumerate(names)})
        cells = F.array(*(F.struct(F.lit(c).alias("metric"), buckets(number(frame, c), ends[f"a{i}"], ends[f"b{i}"], cuts).alias("bucket")) for i, c in enumerate(names)))
        long = frame.select(F.inline(cells), number(frame, y).alias("_y"), present(frame, y).isNotNull().alias("_p"))
        rate = F.bround(F.coalesce(F.sum("_y"), F.lit(0.0)) / F.count("*") * 100, 2)
        part = long.groupBy("metric", "bucket").agg(rate.alias(y), F.count("*").alias("samples")).select("bucket", y, "samples", "metric", F.lit(context).alias("metric_context"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no frame has a numeric column to analyse")
    return out


def dic_count_complexity(dic: dict) -> int:
    """The product of the sizes of all values: rows of frames, lengths of lists."""
    return math.prod(v.count() if isinstance(v, DataFrame) else len(v) for v in dic.values())


def dic_resample_values(params: dict[str, list], n: int, seed: int | None = None) -> dict[str, list]:
    """A random n of each list, in a new dictionary; shorter lists stay as they are."""
    rng = random.Random(seed)
    return {k: rng.sample(list(v), n) if n <= len(v) else v for k, v in params.items()}
