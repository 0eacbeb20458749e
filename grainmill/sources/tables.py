"""Sources: delimited files, synthetic data and time sequences."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from grainmill.functions.core import named


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_large_csv(spark: SparkSession, file_path: str, n: int | None = None, cols: Sequence[str] | None = None, dtype: str = "double", chunks: int | None = None) -> DataFrame:
    """The first n rows (all by default) of a CSV file with a header: the named columns, as numbers of one type.

    Only the named columns are parsed. Which rows are the first is certain for a single file that is read as one
    partition; larger ones give n rows of the first partitions.
    """
    raw = spark.read.option("header", True).csv(file_path)
    picked = raw.select(*(named(c).try_cast(dtype).alias(c) for c in (cols or raw.columns)))
    return picked if n is None else picked.limit(n)


def create_synth_data(spark: SparkSession, mode: str = "binary", n: int = 1000, features: int = 20, classes: int = 4, seed: int = 0) -> DataFrame:
    """n rows of (x: array of features, y): y is 0/1, a class, an array of 0/1 per class, or a linear function of x
    (mode binary, multi_class, multi_label, continuous)."""
    uniform = lambda k: F.rand(seed * 1000 + k)
    x = F.array(*((F.randn if mode == "continuous" else F.rand)(seed * 1000 + k) for k in range(features)))
    rows = spark.range(n).select(F.col("id"), x.alias("x"))
    if mode == "binary":
        y = F.floor(uniform(500) * 2).cast("int")
    elif mode == "multi_class":
        y = F.floor(uniform(500) * classes).cast("int")
    elif mode == "multi_label":
        y = F.array(*((uniform(500 + k) < 0.5).cast("int") for k in range(classes)))
    elif mode == "continuous":
        weights = F.lit([float((37 * k + 11) % 100) for k in range(features)])
        y = F.aggregate(F.zip_with("x", weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    else:
        raise ValueError(f"mode is binary, multi_class, multi_label or continuous, not {mode!r}")
    return rows.select("id", "x", y.alias("y"))


#: strftime letters and the patterns that mean the same.
_PATTERNS = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%b": "MMM", "%B": "MMMM", "%j": "DDD"}


def java_pattern(time_format: str) -> str:
    out = re.sub(r"(?<!%)[A-Za-z]+", lambda m: f"'{m[0]}'", time_format)
    for a, b in _PATTERNS.items():
        out = out.replace(a, b)
    return out


def create_time_sequence(spark: SparkSession, periods: int, start_year: int, start_month: int, start_date: int = 1, time_format: str = "%m-%Y", period: str = "month") -> DataFrame:
    """(position, stamp): `periods` formatted dates, a month, week or day apart."""
    step = {"month": "1 month", "week": "7 days", "day": "1 day"}.get(period)
    if step is None:
        raise ValueError(f"period is month, week or day, not {period!r}")
    start = F.make_date(F.lit(start_year), F.lit(start_month), F.lit(start_date))
    at = F.add_months(start, F.col("id").cast("int")) if period == "month" else F.date_add(start, (F.col("id") * (7 if period == "week" else 1)).cast("int"))
    return spark.range(periods).select(F.col("id").alias("position"), F.date_format(at, java_pattern(time_format)).alias("stamp"))


#: Seconds of the named steps: a year has 365 days, a month 30.
STEPS = {"year": 365 * 86400, "month": 30 * 86400, "day": 86400, "hour": 3600, "minute": 60, "second": 1}


def create_datetime_col(data: DataFrame | SparkSession, start: str, end: str, freq: str, name: str = "datetime") -> tuple[DataFrame, bool | None]:
    """(the timestamps from start to end, a step of freq apart, with their position; whether they are as many as data's rows)."""
    spark = data if isinstance(data, SparkSession) else data.sparkSession
    seconds = STEPS[freq]
    a, b = (F.unix_seconds(F.lit(x).cast("timestamp")) for x in (start, end))
    n = spark.range(1).select(F.greatest(F.floor((b - a) / seconds) + 1, F.lit(0)).cast("bigint")).first()[0]
    out = spark.range(n).select(F.col("id").alias("position"), F.timestamp_seconds(a + F.col("id") * seconds).alias(name))
    return out, None if isinstance(data, SparkSession) else data.count() == n
