"""Values worked out by hand, missing values, and empty and single-row frames."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import grainmill as g
from grainmill.functions import core
from grainmill.functions.core import MOST_VALUES, few_values, modes, number_rows, quantiles
from grainmill.operators import clean, transform
from grainmill.operators.corr import correlations
from grainmill.operators.tensors import sequence_windows
from grainmill.operators.transform import bucket_edges, edge_label

NAN = float("nan")


def rows(df, *by):
    return [tuple(r) for r in (df.orderBy(*by) if by else df).collect()]


@pytest.fixture(scope="module")
def gaps(spark):
    data = [("a", 1.0), ("a", NAN), ("a", None), ("b", 4.0), (None, 8.0)]
    return spark.createDataFrame(data, "k string, x double")


def test_missing_values_are_left_out_of_groups(gaps):
    got = rows(g.col_groupby_stats(gaps, "k", "x"), F.col("k").asc_nulls_last())
    assert got == [("a", None, 1.0, 1, 1.0), ("b", None, 4.0, 1, 4.0), (None, None, 8.0, 1, 8.0)]


def test_profiles(gaps):
    assert dict(rows(g.df_count_uniques(gaps))) == {"k": 3, "x": 4}
    assert {r[0]: r[1:] for r in rows(g.df_find_nan(gaps))} == {"k": (False, 0.8), "x": (False, 0.6)}
    assert rows(g.df_drop_nanrows(gaps), "k") == [("a", 1.0), ("b", 4.0)]
    assert g.df_drop_nancols(gaps, 0.7).columns == ["k"]
    assert g.df_drop_nancols(gaps, max_nan_fraction=0.5).columns == ["k", "x"]


def test_empty_frames(spark, gaps):
    none = gaps.limit(0)
    assert rows(g.col_groupby_stats(none, "k", "x")) == []
    assert rows(g.df_find_nan(none)) == [("k", True, None), ("x", True, None)]
    assert not g.col_check_allsame(none, "x")
    assert g.col_to_buckets(none, "x").count() == 0
    assert g.df_rescale_meanzero(none).count() == 0
    assert g.df_impute_nan(none).count() == 0
    assert g.array_to_kfold(none, 3, key="x").count() == 0
    assert g.col_drop_outliers(none, "x", "iqr").count() == 0
    assert number_rows(none, "x", "n").count() == 0


def test_single_row(spark):
    one = spark.createDataFrame([(1, 5.0)], "id int, x double")
    assert rows(g.df_rescale_meanzero(one, "id")) == [(1, None)]
    assert g.col_drop_outliers(one, "x").count() == 0
    assert g.col_check_allsame(one, "x")


def test_number_rows_agrees_with_a_global_sort(spark):
    data = [(random.Random(i).choice([None, 1, 2, 3, 50, 700]), i) for i in range(500)]
    df = spark.createDataFrame(data, "a int, b int").repartition(7)
    want = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert rows(number_rows(df, ["a", "b"], "n").orderBy("n")) == [(*r, i) for i, r in enumerate(want)]


def test_number_rows_cuts_strings_at_sampled_values(spark):
    pick = random.Random(0)
    data = [(pick.choice([None, "", "hot", "hot", "zoë", "a" * 5000, str(pick.random())]), i) for i in range(3000)]
    df = spark.createDataFrame(data, "`s.t` string, b int").repartition(7)
    want = sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    numbered = number_rows(df, ["s.t", "b"], "n")
    assert rows(numbered.orderBy("n")) == [(*r, i) for i, r in enumerate(want)]
    assert numbered.select(F.spark_partition_id()).distinct().count() > 1
    assert number_rows(df.where("b < 0"), ["s.t"], "n").count() == 0
    assert rows(number_rows(spark.createDataFrame([(None,)], "s string"), "s", "n")) == [(None, 0)]


def test_many_values_are_an_error(spark):
    many = spark.range(MOST_VALUES + 1).select(F.col("id").alias("k"), F.col("id").cast("string").alias("s"), F.lit(1.0).alias("v"))
    for f in (lambda: g.col_to_multilabel(many, "s"), lambda: g.col_to_binary(many, "s", "cat_string"), lambda: g.col_to_cols(many, "s", "k"), lambda: g.array_random_weighted(many, "k", "v", 5)):
        with pytest.raises(ValueError, match="more than"):
            f()
    assert few_values(many.where("k < 3").union(many.where("k < 2")), "k") == [0, 1, 2]


def test_weighted_draws(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 0.0), ("c", 1.0)], "x string, w double")
    got = g.array_random_weighted(df, "x", "w", 4000, seed=1)
    n = {r[0]: r[1] for r in got.groupBy("x").count().collect()}
    assert set(n) == {"a", "c"} and abs(n["a"] / 4000 - 0.75) < 0.03
    assert rows(got.orderBy("draw")) == rows(g.array_random_weighted(df.repartition(3), "x", "w", 4000, seed=1).orderBy("draw"))


def test_bucket_labels():
    edges = bucket_edges(1, 10, 5)
    assert [edge_label(e) for e in edges] == ["0.991", "2.8", "4.6", "6.4", "8.2", "10.0"]


def test_buckets(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (10.0,), (None,)], "x double")
    got = [r[0] for r in g.col_to_buckets(df, "x").collect()]
    assert got == ["0.991 to 2.8", "0.991 to 2.8", "2.8 to 4.6", "2.8 to 4.6", "8.2 to 10.0", ""]
    same = g.col_to_buckets(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x").distinct().count()
    assert same == 1


def test_clean_names(spark):
    df = spark.createDataFrame([(1, 2)], ["  A-b  c!", "Q"])
    assert g.df_clean_colnames(df).columns == ["a_b_c", "q"]
    with pytest.raises(ValueError):
        g.df_clean_colnames(spark.createDataFrame([(1, 2)], ["A b", "A_b"]))


def test_absent_columns_are_errors(gaps):
    for f in (lambda: g.df_drop_col(gaps, "zz"), lambda: g.df_rename_col(gaps, "zz", "y"), lambda: g.col_move_place(gaps, "zz")):
        with pytest.raises(KeyError):
            f()


def test_numeric_strings(spark):
    df = spark.createDataFrame([("1", "1", "1", " 5 "), ("2", "2.5", "x", None)], "i string, d string, s string, n string")
    assert dict(g.df_to_numeric(df).dtypes) == {"i": "bigint", "d": "double", "s": "string", "n": "bigint"}
    values = spark.createDataFrame([(s,) for s in (" 5 ", "nan", "1_000", "1e3", "5d", "", "-.5", "1__0", None)], "s string")
    assert [r[0] for r in values.select(g.is_number(F.col("s"))).collect()] == [True, True, True, True, False, False, True, False, False]
    assert g.is_number("12") and not g.is_number("x") and not g.is_number(None)


def test_blanks(spark):
    df = spark.createDataFrame([("",), (" \t",), (" x ",), (None,)], "s string")
    assert [r[0] for r in g.df_fill_empty(df, "E").collect()] == ["E", "E", "x", None]


def test_logs_and_roots(spark):
    df = spark.createDataFrame([(0.0, 1), (-1.0, 2), (-2.0, 3)], "x double, id int")
    got = g.df_rescale_log(df, "id")
    assert got.columns == ["x", "id"]
    assert [r[0] for r in got.orderBy("id").collect()][:2] == [0.0, -math.inf]
    assert math.isnan(got.where("id = 3").first()[0]) and math.isnan(g.df_rescale_sqrt(df, "id").where("id = 3").first()[0])


def test_resampling_fills_gaps(spark):
    data = [("2024-01-01 00:05:00", 1.0), ("2024-01-01 00:59:00", 2.0), ("2024-01-01 01:00:00", 3.0), ("2024-01-01 03:10:00", 4.0)]
    df = spark.createDataFrame(data, "t string, x double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = rows(g.col_resample_interval(df, "x", "t", "sum", 60), "t")
    assert [(t.hour, x) for t, x in got] == [(1, 3.0), (2, 3.0), (3, 0.0), (4, 4.0)]
    assert g.col_resample_interval(df, "x", "t", "mean", 60, fill=False).count() == 3


def test_modes_and_order(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 3), ("b", 4), ("c", 5)], "v string, o int").withColumn("k", F.lit(1))
    assert g.df_to_groupby(df.select("k", "v"), "k", "mode").first()["v"] == "a"
    assert g.df_to_groupby(df, "k", "string", order_by="o").first()["v"] == "b a a b c"
    with pytest.raises(ValueError):
        g.df_to_groupby(df.select("k", "v"), "k", "first")


def test_pivot_keeps_missing_combinations(spark):
    df = spark.createDataFrame([("x", 1, 1), ("y", 1, 2), ("x", 2, 3)], "l string, h int, v int")
    assert rows(g.col_to_cols(df, "l", "h"), "h") == [(1, 1.0, 2.0), (2, 3.0, None)]


def test_merge_matches_missing_keys(spark):
    a = spark.createDataFrame([(1, "p"), (None, "q")], "k int, v string")
    b = spark.createDataFrame([(1, "r"), (None, "s")], "k int, v string")
    assert rows(g.df_merge(a, b, False, "k"), F.col("k").asc_nulls_first()) == [(None, "q", "s"), (1, "p", "r")]
    assert g.df_merge(a, b, False, "k", null_safe=False).count() == 1


@pytest.mark.parametrize(("n", "hot"), [(0, 0), (1, 0), (2, 0), (3, 0), (50, 0), (301, 0), (301, 0.5), (301, 1)])
def test_kendall_agrees_with_all_pairs(spark, n, hot):
    rng = np.random.default_rng(n)
    for wide in (False, True):
        x, y = (rng.normal(size=n), rng.normal(size=n)) if wide else (rng.integers(0, 8, n).astype(float), rng.integers(0, 12, n).astype(float))
        x[: int(n * hot)] = 3.0
        s = nx = ny = 0
        for i in range(n):
            for j in range(i):
                a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
                s, nx, ny = s + a * b, nx + abs(a), ny + abs(b)
        want = s / math.sqrt(nx * ny) if nx * ny else None
        odd = [(None, 1.0), (float("nan"), 2.0), (5.0, None)]
        df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + odd, "x double, y double")
        got = correlations(df, [("x", "y")], "kendall", range_rows=25)[("x", "y")]
        assert got == want or abs(got - want) < 1e-12


def test_binary_and_codes(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (None, None), (4.0, "a")], "x double, s string")
    assert [r[0] for r in g.col_to_binary(df, "x", "median").collect()] == [False, True, False, True]
    assert [r[1] for r in g.col_to_binary(df, "s", "cat_string").collect()] == [1, 0, -1, 0]
    assert [r[1] for r in g.col_to_biclass(df, "s", "a").collect()] == [0, 1, 0, 1]
    assert g.col_to_multilabel(df, "s").columns == ["x", "a", "b"]
    assert [r[0] for r in g.col_to_binary(df, "x", "cat_numeric").collect()] == [0, 2, -1, 4]


def test_colliding_dummies_get_prefixes(spark):
    df = spark.createDataFrame([("u", "u"), ("v", "w")], "a string, b string")
    assert g.df_to_multilabel(df).columns == ["a_u", "a_v", "b_u", "b_w"]


def test_imputing(spark):
    df = spark.createDataFrame([(1.0,), (2.6,), (NAN,), (None,)], "x double")
    assert [r[0] for r in g.col_impute_nan(df, "x", "mean").collect()][2:] == [1.0, 1.0]
    assert [r[0] for r in g.col_impute_nan(df, "x", "mean", truncate=False).collect()][2:] == [1.8, 1.8]
    assert g.col_fill_nan(df, "x", 7).columns == ["x"]


def test_samples_are_reproducible_under_repartitioning(spark):
    df = spark.range(300).withColumn("c", F.col("id") % 3)
    a = rows(g.df_resample_stratified(df, "c", 10, key="id"), "id")
    assert a == rows(g.df_resample_stratified(df.repartition(5), "c", 10, key="id"), "id") and len(a) == 30
    with pytest.raises(ValueError):
        g.col_resample_equal(df, "c", 101, key="id")


def test_splits_cover_everything_once(spark):
    df = spark.range(100)
    train, val = g.array_split(df, 0.25, key="id")
    assert (train.count(), val.count()) == (75, 25) and train.intersect(val).count() == 0
    folds = g.array_to_kfold(df, 7, key="id")
    assert folds.count() == 98 and {r["count"] for r in folds.groupBy("fold").count().collect()} == {14}


def test_sequences(spark):
    df = spark.createDataFrame([(i, float(i + 1)) for i in range(12)], "t int, v double")
    got = g.array_reshape_lstm(df, "v", 3, order_by="t")
    assert got.count() == 8
    first = got.where("idx = 0").first()
    assert first["x"] == [[1.0], [2.0], [3.0]] and first["y"] == 4.0 and got.where("split = 'train'").count() == 7


def test_batches(spark):
    df = spark.createDataFrame([(i, float(i), i % 2) for i in range(5)], "t int, a double, y int")
    made = list(g.array_to_generator(df, ["a"], "y", 2, "t", endless=False))
    assert [len(x) for x, _ in made] == [2, 2, 1] and made[0][0].dtype == np.float32
    assert made[2][0].tolist() == [[4.0]] and made[2][1].tolist() == [0.0]


def test_small_things(spark):
    df = spark.createDataFrame([(7, "ab-c"), (120, "x")], "n int, s string")
    assert [r["chars"] for r in g.int_to_chars(df, "n").collect()] == [["0", "0", "7"], ["1", "2", "0"]]
    assert g.col_to_split(df, "s", sep="-").columns == ["n", "s_a", "s_b"]
    assert rows(g.col_to_split(df, "s", sep="-").select("s_a", "s_b"), "s_a") == [("ab", "c"), ("x", None)]
    assert [r[0] for r in g.value_starts_with(df, "s").select("s").collect()] == ["a", "x"]
    with pytest.raises(NotImplementedError):
        g.df_to_binary(df, "n")
    assert g.array_detect_task(df, ["n", "s"]) == ("category", 2, "onehot")
    assert g.df_restructure_values(df, "tuple").first()["n"] == ("n", "7")
    assert g.df_restructure_values(df, "nothing").columns == ["n", "s"]


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n1,2,x\n3,4.5,y\n5,oops,z\n")
    got = g.read_large_csv(spark, str(tmp_path / "t.csv"), 3, ["a", "b"])
    assert rows(got) == [(1.0, 2.0), (3.0, 4.5), (5.0, None)]
    assert g.read_large_csv(spark, str(tmp_path / "t.csv"), 1).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = g.stream_resample_interval(stream, "value", "ts", "sum", 240).writeStream.outputMode("complete").format("memory").queryName("resampled").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = rows(spark.sql("SELECT ts, round(value, 4) FROM resampled"), "ts")
    want = rows(g.stream_resample_interval(events, "value", "ts", "sum", 240).select("ts", F.round("value", 4)), "ts")
    assert got == want and len(got) > 100


def test_sequences_reach_over_blocks(spark, monkeypatch):
    from grainmill.operators import tensors

    monkeypatch.setattr(tensors, "BLOCK_ROWS", 1)
    values = [None if i % 17 == 3 else float(i * i % 101) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(values)), "t int, v double").repartition(5)
    for seq_len in (1, 3, 7):
        got = tensors.sequence_windows(df, "v", seq_len, "t").orderBy("idx").collect()
        assert [(r["idx"], r["window"]) for r in got] == [(i, values[i : i + seq_len + 1]) for i in range(200 - seq_len - 1)]


def test_windows_that_begin_with_zero_divide_by_it(spark):
    df = spark.createDataFrame(list(enumerate([0.0, 0.0, 3.0, -2.0, -0.0, 4.0, None, 1.0, 1.0])), "t int, v double")
    got = [r["window"] for r in sequence_windows(df, "v", 2, "t", True).orderBy("idx").collect()]
    nan, inf = float("nan"), float("inf")
    want = [[nan, nan, inf], [nan, inf, -inf], [0.0, -2 / 3 - 1, -1.0], [0.0, -1.0, -3.0], [nan, -inf, None], [0.0, None, 1 / 4 - 1]]
    assert str(got) == str(want)


def test_entropy_of_groups_with_a_zero(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 0.0), ("b", 2.0), ("b", 2.0), ("b", None), ("c", None)], "k string, v double")
    assert rows(g.df_to_groupby(df, "k", "entropy").select("k", F.round("v", 9)), "k") == [("a", round(math.log(2), 9)), ("b", round(math.log(2), 9)), ("c", None)]
    strict = dict(rows(g.df_to_groupby(df, "k", "strict_entropy").select("k", F.round("v", 9))))
    assert math.isnan(strict["a"]) and strict["b"] == round(math.log(2), 9) and strict["c"] is None


def planted(spark, n=4000):
    rng = np.random.default_rng(5)
    a, b, c, d = rng.integers(0, 6, n), rng.normal(size=n), rng.integers(0, 2, n), rng.normal(size=n)
    y = 5.0 * (a >= 3) + 2.0 * (b > 0.2) + 0.01 * d
    return spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, y, strict=True)] + [(None, 1.0, 1.0, 1.0), (1.0, NAN, 1.0, 2.0)], "a double, b double, c double, y double")


def test_forests_do_not_depend_on_partitions(spark):
    df = planted(spark)
    classed = df.withColumn("y", F.floor("y").cast("double"))
    for make, data in ((g.df_corr_randomforest, df), (g.df_corr_extratrees, classed)):
        one, many = (dict(rows(make(data.repartition(k), "y"))) for k in (1, 7))
        assert list(one) == ["a", "b", "c"] and sum(one.values()) == pytest.approx(1) and one == pytest.approx(many, abs=1e-9)
        assert one["a"] > one["b"] > 4 * one["c"]


def test_importances_agree_with_trees_over_rows(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    df = planted(spark)
    vectors = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df.where("a is not null and not isnan(b)"))
    want = RandomForestRegressor(labelCol="y", maxDepth=3, numTrees=100, seed=0).fit(vectors).featureImportances.toArray()
    got = dict(rows(g.df_corr_randomforest(df, "y")))
    assert [got[c] for c in "abc"] == pytest.approx(want.tolist(), abs=0.12)


def test_forests_on_odd_frames(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0)] * 5, "a double, b double, y double")
    for make in (g.df_corr_randomforest, g.df_corr_extratrees):
        assert rows(make(df, "y")) == [("a", 0.0), ("b", 0.0)] == rows(make(df.limit(0), "y"))
        assert rows(make(df.select("y"), "y")) == []
    two = spark.createDataFrame([(float(i % 2), float(i % 2)) for i in range(300)], "a double, y double")
    assert rows(g.df_corr_extratrees(two, "y")) == rows(g.df_corr_randomforest(two, "y")) == [("a", 1.0)]


def widest_state(spark, make):
    """Aggregates that keep all different values of a column as one state, in the plans of the jobs that make starts."""
    plans, fit = [], core.fit

    def seen(data, aggregates):
        plans.append(str(data.agg(*aggregates.values())._jdf.queryExecution().analyzed()))
        return fit(data, aggregates)

    with pytest.MonkeyPatch.context() as m:
        for module in (core, clean, transform):
            m.setattr(module, "fit", seen)
        make()
    return [w for w in ("percentile(", "median(", "mode(") if any(w in p for p in plans)]


def test_quantiles_and_modes_keep_no_column_in_one_state(spark):
    df = spark.createDataFrame([(i, float(i % 7) if i % 5 else None) for i in range(50)], "k int, v double")
    assert widest_state(spark, lambda: g.col_drop_outliers(df, "v", "iqr", 1.2)) == []
    assert widest_state(spark, lambda: g.df_impute_nan(df, impute_mode="median")) == []
    assert widest_state(spark, lambda: g.df_impute_nan(df, impute_mode="common")) == []


@pytest.mark.parametrize("hot", [0, 0.6, 1])
@pytest.mark.parametrize("n", [1, 2, 3, 50, 30_000])
def test_quantiles_agree_with_percentile(spark, n, hot):
    rng = np.random.default_rng(n)
    v = rng.normal(size=n)
    v[: int(n * hot)] = 0.25
    df = spark.createDataFrame([(float(a),) for a in v] + [(None,), (NAN,)], "v double").repartition(5)
    ps = [0.0, 0.25, 0.3, 0.5, 0.75, 1.0]
    want = df.where("not isnan(v)").agg(F.percentile("v", F.array(*map(F.lit, ps)))).first()[0]
    assert quantiles(df, {"v": ps})["v"] == want
    assert quantiles(df.where("v is null"), {"v": ps}) == {"v": None}


def test_quantiles_are_found_when_the_bracket_is_off(spark, monkeypatch):
    approx = F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda x, ps, accuracy: approx(x, [min(p + 0.01, 1.0) if ps[0] > 0 else p for p in ps], accuracy))
    df = spark.range(20_001).select(F.col("id").cast("double").alias("v"))
    assert quantiles(df, {"v": [0.5]}) == {"v": [10_000.0]}


def test_modes_are_the_smallest_of_the_most_frequent(spark):
    df = spark.createDataFrame([(3.0, None), (3.0, None), (-1.0, None), (-1.0, None), (NAN, NAN), (NAN, NAN), (NAN, NAN), (7.0, None)], "a double, b double")
    assert modes(df, ["a", "b"]) == {"a": -1.0, "b": None}
