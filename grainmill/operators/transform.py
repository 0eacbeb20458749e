"""Value transforms: rescaling, encoding, binning, filling and imputing.

Transforms that depend on the data fit their scalars in one aggregate and put them into the
projection as literals, so the projection itself stays a narrow, code-generated step.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from grainmill.functions.core import as_list, categories, code, few_values, fit, is_numeric, kind, modes, named, number, numeric_columns, present, quantiles, require, string_columns, unique_counts, with_columns
from grainmill.operators.clean import is_number, string_contains_to_binary


def df_to_lower(data: DataFrame, cols: str | Sequence[str] | None = None) -> DataFrame:
    names = data.columns if cols is None else require(data, cols)
    return with_columns(data, {c: F.lower(named(c)) for c in names if c in string_columns(data)})


def df_fill_empty(data: DataFrame, fill_with) -> DataFrame:
    """All columns as text, stripped of white space, what is empty then filled; missing stays missing."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(named(c).cast("string"), r"^\s+", ""), r"\s+$", "")
    return with_columns(data, {c: F.when(bare(c) == "", F.lit(str(fill_with))).otherwise(bare(c)) for c in data.columns})


def df_to_numeric(data: DataFrame, destructive: bool = False) -> DataFrame:
    """String columns of which every value parses become bigint, or double; one pass decides for all of them."""
    names = string_columns(data)
    if not names:
        return data
    whole = lambda c: F.trim(named(c)).try_cast("bigint")
    real = lambda c: F.trim(named(c)).try_cast("double")
    bad = lambda c, parsed: F.count_if(named(c).isNotNull() & parsed.isNull())
    ok_real = lambda c: F.when(is_number(named(c)), real(c))
    row = fit(data, {f"n{i}": F.count(named(c)) for i, c in enumerate(names)} | {f"i{i}": bad(c, whole(c)) for i, c in enumerate(names)} | {f"d{i}": bad(c, ok_real(c)) for i, c in enumerate(names)})
    new = {}
    for i, c in enumerate(names):
        if row[f"n{i}"] and not row[f"i{i}"]:
            new[c] = whole(c)
        elif row[f"n{i}"] and not row[f"d{i}"]:
            new[c] = real(c)
    return with_columns(data, new)


def _kept_last(data: DataFrame, retain: Sequence[str], new: dict[str, Column]) -> DataFrame:
    """Retained columns untouched and last, as before otherwise."""
    out = with_columns(data, new)
    return out.select(*(named(c) for c in data.columns if c not in retain), *(named(c) for c in retain))


def df_rescale_log(data: DataFrame, retain_cols: str | Sequence[str] | None = None, destructive: bool = False) -> DataFrame:
    """log(1 + x) of the numeric columns: -inf at -1, NaN below."""
    retain = require(data, retain_cols) if retain_cols else []
    log = lambda x: F.when(x < -1, F.lit(math.nan)).when(x == -1, F.lit(-math.inf)).otherwise(F.log1p(x))
    return _kept_last(data, retain, {c: log(named(c).cast("double")) for c in numeric_columns(data, retain)})


def df_rescale_sqrt(data: DataFrame, retain_cols: str | Sequence[str] | None = None, destructive: bool = False) -> DataFrame:
    """The square root of the numeric columns, NaN below 0."""
    retain = require(data, retain_cols) if retain_cols else []
    return _kept_last(data, retain, {c: F.sqrt(named(c).cast("double")) for c in numeric_columns(data, retain)})


def df_rescale_meanzero(data: DataFrame, retain: str | Sequence[str] | None = None) -> DataFrame:
    """Numeric columns less their mean, over their sample deviation; null if that is 0."""
    names = numeric_columns(data, as_list(retain))
    if not names:
        return data
    s = fit(data, {f"m{i}": F.avg(number(data, c)) for i, c in enumerate(names)} | {f"s{i}": F.stddev_samp(number(data, c)) for i, c in enumerate(names)})
    z = lambda i, c: F.try_divide(number(data, c) - F.lit(s[f"m{i}"]).cast("double"), F.lit(s[f"s{i}"]).cast("double"))
    return with_columns(data, {c: z(i, c) for i, c in enumerate(names)})


def col_rescale_max(data: DataFrame, col: str, scale: float = 1, to_int: bool = False) -> DataFrame:
    """x * scale / max, rounded up to an integer if to_int."""
    top = fit(data, {"m": F.max(number(data, col))})["m"]
    x = F.try_divide(number(data, col) * F.lit(float(scale)), F.lit(top).cast("double"))
    return with_columns(data, {col: F.ceil(x).cast("bigint") if to_int else x})


def col_to_biclass(data: DataFrame, col: str, true_value, destructive: bool = False) -> DataFrame:
    """1 where the column has the value, else 0, also where it is missing."""
    return with_columns(data, {col: named(col).eqNullSafe(F.lit(true_value)).cast("int")})


def col_to_binary(data: DataFrame, col: str, func: str | float | int = "median", destructive: bool = False) -> DataFrame:
    """Whether the value is at least the mean, median, smallest mode, a number (int) or a quantile (float); or its category's code
    (cat_string; up to MOST_VALUES of them), or its fifth (cat_numeric: 0 to 4, -1 if missing); anything else leaves the column as it is."""
    x = present(data, col)
    at_least = lambda s: with_columns(data, {col: F.coalesce(x >= F.lit(s), F.lit(False))})
    if isinstance(func, int):
        return at_least(func)
    if isinstance(func, float):
        return at_least((quantiles(data, {col: [func]})[col] or [None])[0])
    if func == "mean":
        return at_least(fit(data, {"s": F.avg(number(data, col))})["s"])
    if func == "median":
        return at_least((quantiles(data, {col: [0.5]})[col] or [None])[0])
    if func == "mode":
        counts = data.select(x.alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        return at_least(fit(counts, {"s": F.min_by("v", F.struct((-F.col("n")).alias("n"), "v"))})["s"])
    if func == "cat_string":
        return with_columns(data, {col: code(data, col, few_values(data, col))})
    if func == "cat_numeric":
        edges = quantiles(data, {col: [i / 5 for i in range(6)]})[col]
        return with_columns(data, {col: _bin(number(data, col), sorted(set(edges or [])))})
    return data


def _bin(x: Column, edges: Sequence[float]) -> Column:
    """The number of the right-closed interval between edges (the first closed on both sides), -1 if missing or outside."""
    out = F.when(x.isNull(), F.lit(-1))
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        out = out.when(((x >= a) if i == 0 else (x > a)) & (x <= b), F.lit(i))
    return out.otherwise(F.lit(-1))


def bucket_edges(low: float, high: float, cuts: int) -> list[float]:
    """cuts + 1 edges of equal width, the first lowered by a thousandth of the range; a single value is widened by as much on both sides."""
    if low == high:
        pad = 0.001 * abs(low) if low else 0.001
        low, high = low - pad, high + pad
        return [low + (high - low) * i / cuts for i in range(cuts + 1)]
    edges = [low + (high - low) * i / cuts for i in range(cuts)] + [high]
    return [low - 0.001 * (high - low), *edges[1:]]


def edge_label(x: float) -> str:
    """The edge at three decimals, or at three significant digits if its whole part is 0."""
    whole = math.trunc(x)
    if x == 0 or not math.isfinite(x):
        return repr(x)
    digits = 3 if whole else -math.floor(math.log10(abs(x - whole))) - 1 + 3
    return repr(round(x, digits) + 0.0)


def buckets(x: Column, low: float | None, high: float | None, cuts: int = 5, rounding: bool = False) -> Column:
    """The label "left to right" of the bucket, '' if missing."""
    if low is None:
        return F.lit("")
    edges = bucket_edges(float(low), float(high), cuts)
    text = [str(int(e)) if rounding else edge_label(e) for e in edges]
    out = F.when(x.isNull(), F.lit(""))
    for i in range(cuts):
        out = out.when((x > edges[i]) & (x <= edges[i + 1]) if i < cuts - 1 else x > edges[i], F.lit(f"{text[i]} to {text[i + 1]}"))
    return out.otherwise(F.lit(""))


def col_to_buckets(data: DataFrame, col: str, cuts: int = 5, rounding: bool = False) -> DataFrame:
    """The column as labels of buckets of equal width."""
    s = fit(data, {"a": F.min(number(data, col)), "b": F.max(number(data, col))})
    return with_columns(data, {col: buckets(number(data, col), s["a"], s["b"], cuts, rounding)})


def _few(data: DataFrame, max_uniques: int, ignore_y: str | None) -> list[str]:
    counts = unique_counts(data, [c for c in data.columns if c != ignore_y])
    return [c for c, n in counts.items() if n <= max_uniques]


def df_to_multiclass(data: DataFrame, max_uniques: int = 30, ignore_y: str | None = None, destructive: bool = False) -> DataFrame:
    """Columns with few values as the codes of their sorted values, -1 if missing."""
    values = categories(data, _few(data, max_uniques, ignore_y))
    return with_columns(data, {c: code(data, c, v) for c, v in values.items()})


def _dummies(data: DataFrame, name: str, values: Sequence, names: Sequence[str]) -> dict[str, Column]:
    return {n: present(data, name).eqNullSafe(F.lit(v).cast(kind(data, name))).cast("int") for n, v in zip(names, values, strict=True)}


def col_to_multilabel(data: DataFrame, col: str, colnames: Sequence[str] | None = None, extended_colname: bool = False, extended_separator: str = "_") -> DataFrame:
    """A 0/1 column for each sorted value in place of the column, appended; a missing value is all zeros. Beyond MOST_VALUES values it is an error."""
    values = few_values(data, col)
    names = list(colnames) if colnames else [f"{col}{extended_separator}{v}" if extended_colname else str(v) for v in values]
    return with_columns(data, _dummies(data, col, values, names)).select(*(named(c) for c in data.columns if c != col), *(named(n) for n in names))


def df_to_multilabel(data: DataFrame, max_uniques: int = 30, ignore_y: str | None = None, destructive: bool = False) -> DataFrame:
    """The same for every column with few values; names that would collide get their column's name before them."""
    values = categories(data, _few(data, max_uniques, ignore_y))
    rest = [c for c in data.columns if c not in values]
    bare = [str(v) for vs in values.values() for v in vs]
    new: dict[str, Column] = {}
    for c, vs in values.items():
        clash = any(bare.count(str(v)) > 1 or str(v) in rest for v in vs)
        new |= _dummies(data, c, vs, [f"{c}_{v}" if clash else str(v) for v in vs])
    return data.select(*(named(c) for c in rest), *(v.alias(k) for k, v in new.items()))


def array_to_multilabel(data: DataFrame, y: str, out: str = "labels") -> DataFrame:
    """Whole-number labels as 0/1 arrays of length max + 1; negative ones are an error."""
    label = named(y).cast("int")
    s = fit(data, {"a": F.min(label), "b": F.max(label)})
    if s["a"] is not None and s["a"] < 0:
        raise ValueError("labels are 0 or more")
    return data.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(s["b"] or 0)), lambda i: F.coalesce(i == label, F.lit(False)).cast("double")))


def array_detect_task(data: DataFrame, y: str | Sequence[str]) -> tuple[str, float, str]:
    """(kind of task, width, encoding): several columns are one-hot categories; a maximum of 1 is binary; mean equal to median a category, else continuous."""
    names = as_list(y)
    if len(names) > 1:
        return ("category", len(names), "onehot")
    x = number(data, names[0])
    s = fit(data, {"a": F.min(x), "b": F.max(x), "m": F.avg(x), "n": F.count_distinct(x)})
    if s["b"] == 1:
        return ("binary", 1, "single")
    median = (quantiles(data, {names[0]: [0.5]})[names[0]] or [None])[0]
    return ("category", s["n"], "single") if s["m"] == median else ("continuous", s["b"] - s["a"], "single")


def col_fill_nan(data: DataFrame, cols: str | Sequence[str], fill_with=0) -> DataFrame:
    """The filled column alone for a name, the whole frame for a list; strings are filled with the value's text."""
    fill = lambda c: F.coalesce(present(data, c), F.lit(str(fill_with) if isinstance(kind(data, c), T.StringType) else fill_with).cast(kind(data, c)))
    if isinstance(cols, str):
        return data.select(fill(cols).alias(cols))
    return with_columns(data, {c: fill(c) for c in require(data, cols)})


def _imputed(data: DataFrame, names: Sequence[str], mode: str, seed: int, truncate: bool) -> dict[str, Column]:
    known = ("mean", "median", "mode", "common", "mean_by_std")
    if mode not in known:
        raise ValueError(f"impute_mode is one of {', '.join(known)}, not {mode!r}")
    if not names:
        return {}
    if mode in ("mean", "mean_by_std"):
        spread = {f"s{i}": F.stddev_samp(number(data, c)) for i, c in enumerate(names)} if mode == "mean_by_std" else {}
        row = fit(data, {f"v{i}": F.avg(number(data, c)) for i, c in enumerate(names)} | spread)
    else:
        gaps = fit(data, {f"g{i}": F.max(number(data, c).isNull()) for i, c in enumerate(names)})
        holed = [c for i, c in enumerate(names) if gaps[f"g{i}"]]  # the others need no value
        got = modes(data, holed) if mode != "median" else {c: q and q[0] for c, q in quantiles(data, {c: [0.5] for c in holed}).items()}
        row = {f"v{i}": got.get(c) for i, c in enumerate(names)}
    out = {}
    for i, c in enumerate(names):
        v = row[f"v{i}"]
        if v is None:
            continue
        if mode == "mean_by_std":
            sd = row[f"s{i}"] or 0.0
            low, high = int(v - sd), int(v + sd)
            draw = F.xxhash64(*(named(n) for n in data.columns), F.lit(seed), F.lit(i))  # of the row, so that it survives repartitioning
            new = F.pmod(draw, F.lit(high - low + 1)) + low
        else:
            new = F.lit(int(v) if truncate else v)
        x = present(data, c)
        out[c] = F.coalesce(x, new.cast(kind(data, c)))
    return out


def col_impute_nan(data: DataFrame, col: str, impute_mode: str = "mean_by_std", seed: int = 0, truncate: bool = True) -> DataFrame:
    """Missing values replaced by the mean, median or mode (cut to an integer), or by random integers within a deviation of the mean."""
    return with_columns(data, _imputed(data, require(data, col), impute_mode, seed, truncate))


def df_impute_nan(data: DataFrame, cols: str | Sequence[str] = "all", impute_mode: str = "mean_by_std", destructive: bool = False, seed: int = 0, truncate: bool = True) -> DataFrame:
    """The same for all (or the named) numeric columns, in one projection."""
    names = data.columns if cols == "all" else require(data, cols)
    return with_columns(data, _imputed(data, [c for c in names if is_numeric(data, c)], impute_mode, seed, truncate))


def filling_nans(data: DataFrame, fill_columns: str | Sequence[str], fill_with=0) -> DataFrame:
    return col_fill_nan(data, as_list(fill_columns), fill_with)


def imputing_nans(data: DataFrame, impute_columns: str | Sequence[str], impute_mode: str = "mean_by_std", seed: int = 0) -> DataFrame:
    return df_impute_nan(data, as_list(impute_columns), impute_mode, seed=seed)


def df_add_scorecol(data: DataFrame, metric: str, win_threshold: float = 0.66, lose_threshold: float = 0.33, win_points: int = 2, lose_points: int = -2, tie_points: int = 0, score_col_name: str = "score") -> DataFrame:
    """Points for values from the win quantile up, down to the lose quantile, and between."""
    x = number(data, metric)
    q = quantiles(data, {metric: [lose_threshold, win_threshold]})[metric] or [None, None]
    return data.withColumn(score_col_name, F.when(x >= q[1], F.lit(win_points)).when(x <= q[0], F.lit(lose_points)).otherwise(F.lit(tie_points)))


def value_starts_with(data: DataFrame, col: str) -> DataFrame:
    """Strings replaced by their first characters."""
    return with_columns(data, {col: F.substring(named(col), 1, 1)})


def starts_with_output(data: DataFrame, col: str) -> DataFrame:
    """The codes of the first characters."""
    firsts = value_starts_with(data, col)
    return with_columns(firsts, {col: code(firsts, col, few_values(firsts, col))})


def to_category_labels(data: DataFrame, max_categories: int | str | None = "auto", starts_with_col: str | None = None, col_that_contains: str | None = None, col_contains_strings: Sequence[str] = ()) -> DataFrame:
    """Everything as numbers: parsable columns as doubles, pattern flags, first characters as codes, columns with few values as codes; the rest goes."""
    from grainmill.operators.clean import max_category

    out = df_to_numeric(data)
    out = with_columns(out, {c: named(c).cast("double") for c in numeric_columns(out)})
    if col_that_contains:
        out = string_contains_to_binary(out, col_that_contains, col_contains_strings)
    if starts_with_col:
        out = starts_with_output(out, starts_with_col)
    texts = string_columns(out)
    counts = unique_counts(out, texts)
    most = max_category(data, max_categories)
    values = categories(out, [c for c in texts if counts[c] <= most])
    out = with_columns(out, {c: code(out, c, v) for c, v in values.items()})
    return out.select(*(named(c) for c in out.columns if c not in texts or c in values))


