"""Operators that must stay exact however the values are spread: totals, quantiles, AUC, joins, splits, PSI."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonewatch.operators import drift, running, splits
from tonewatch.operators.lookup import data_bytes, lookup_join


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    values = [5.0] * 500 + [round(rng.gauss(0, 10), 2) for _ in range(1000)]
    return values, spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double").repartition(6)


def test_quantiles_equal_numpy(skewed):
    values, df = skewed
    row = running.exact_quantiles(df, F.col("v"), (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)).first()
    assert list(row) == pytest.approx(list(np.quantile(values, [0, 0.1, 0.25, 0.5, 0.75, 0.99, 1])))


def test_running_totals_equal_a_cumulative_sum(skewed, spark):
    counts = running.value_counts(skewed[1], F.col("v"))
    got = sorted(map(tuple, running.running_totals(counts, "value", ["n"]).select("value", "n", "before_n").collect()))
    before = 0
    for _, n, seen in got:
        assert seen == before
        before += n
    assert before == len(skewed[0])


def test_auc_counts_pairs(spark):
    rng = random.Random(2)
    rows = [(0.5, rng.randint(0, 1)) for _ in range(100)] + [(round(rng.random(), 2), rng.randint(0, 1)) for _ in range(200)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert running.roc_auc(spark.createDataFrame(rows, "score double, label int")).first()["auc"] == pytest.approx(pairs)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_broadcast_join(spark, how):
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 40}") for i in range(600)], "id int, k string")
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(30)], "k string, v int")
    small = lookup_join(rows, table, "k", how)
    large = lookup_join(rows, table, "k", how, max_broadcast_bytes=0, rows_per_task=30)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    columns = ["id", "k", "v"]
    assert Counter(map(tuple, small.select(columns).collect())) == Counter(map(tuple, large.select(columns).collect()))
    whole = lookup_join(rows, table, "k", how, max_broadcast_bytes=0)
    assert Counter(map(tuple, whole.select(columns).collect())) == Counter(map(tuple, small.select(columns).collect()))
    assert small.count() == (600 if how == "left" else rows.filter("k = 'hot' or cast(substr(k, 2) as int) < 30").count())


@pytest.mark.parametrize("how", ["left", "inner"])
def test_rows_without_key_meet_nothing(spark, how):
    rows = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(200)], "id int, k string")
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    found = lookup_join(rows, table, "k", how, max_broadcast_bytes=0, rows_per_task=30)
    expected = [(i, None, None) if i % 2 else (i, "a", 1) for i in range(200) if how == "left" or i % 2 == 0]
    assert Counter(map(tuple, found.select("id", "k", "v").collect())) == Counter(expected)


def test_measured_size_follows_the_values(spark):
    df = spark.createDataFrame([("abc", [1.0, 2.0]), (None, None)], "s string, a array<double>")
    assert data_bytes(df) == 2 * 32 + 3 + 16
    assert data_bytes(df.filter("s = 'none'")) == 0


def test_splits_do_not_depend_on_partitions(spark):
    one = spark.range(2000).repartition(1)
    many = spark.range(2000).repartition(13)
    train, validate = splits.split_train_validate(one, "id")
    assert {r.id for r in train.collect()} == {r.id for r in splits.split_train_validate(many, "id")[0].collect()}
    assert train.count() + validate.count() == 2000
    assert 0.77 < train.count() / 2000 < 0.83


def test_folds_are_disjoint_and_complete(spark):
    rows = spark.range(1000)
    folds = splits.k_fold_split(rows, "id", k=5)
    ids = [r.id for fold in folds for r in fold.collect()]
    assert sorted(ids) == list(range(1000))
    union = {r.id for r in splits.fold_union(folds, 2).collect()}
    assert union == {r.id for r in splits.fold_complement(rows, "id", 5, 2).collect()}
    assert union == set(ids) - {r.id for r in folds[2].collect()}


def brute_psi(ref, cur, numeric):
    if numeric and len(set(ref)) > 20:
        low, high = min(ref + cur), max(ref + cur)
        bins = math.ceil(math.log2(len(ref) + len(cur)) + 1)
        width = (high - low) / bins

        def key(v):
            return min(math.floor((v - low) / width), bins - 1)

        keys = range(bins)
    else:
        def key(v):
            return v

        keys = set(ref) | set(cur)

    def shares(side):
        counts = Counter(key(v) for v in side)
        raw = [counts[k] / len(side) for k in keys]
        least = min(s for s in raw if s > 0)
        return [s or (least / 1e6 if least <= 0.0001 else 0.0001) for s in raw]

    return sum((r - c) * math.log(r / c) for r, c in zip(shares(ref), shares(cur)))


VALUES = st.lists(st.integers(-50, 50).map(lambda n: n / 4), min_size=5, max_size=120)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(VALUES, VALUES)
def test_psi_equals_brute_force_and_is_symmetric(spark, ref, cur):
    a, b = (spark.createDataFrame([(v, str(v)) for v in side], "x double, c string") for side in (ref, cur))
    got = {r["column"]: r["value"] for r in drift.psi_table(a, b, ["c"], ["x"]).collect()}
    assert got["x"] == pytest.approx(brute_psi(ref, cur, True), abs=1e-9)
    assert got["c"] == pytest.approx(brute_psi([str(v) for v in ref], [str(v) for v in cur], False), abs=1e-9)
    swapped = drift.psi_table(b, a, ["c"]).first()["value"]
    assert swapped == pytest.approx(got["c"], abs=1e-9)


def test_psi_of_a_batch_with_itself_is_zero(spark):
    df = spark.createDataFrame([(i / 7, str(i % 3)) for i in range(300)], "x double, c string")
    assert [r["value"] for r in drift.psi_table(df, df, ["c"], ["x"]).collect()] == [0.0, 0.0]


def test_psi_with_a_tiny_share_and_bins_empty_on_both_sides(spark):
    ref = [float(i % 40) for i in range(30000)] + [1000.0]
    cur = [float(i % 25) for i in range(5000)]
    a, b = (spark.createDataFrame([(v,) for v in side], "x double") for side in (ref, cur))
    assert drift.psi_numeric(a, b, "x").first()["value"] == pytest.approx(brute_psi(ref, cur, True), abs=1e-9)


def test_psi_leaves_out_missing_and_infinite_values(spark):
    ref, cur = [i / 3 for i in range(200)], [i / 2 for i in range(150)]
    bad = [None, float("nan"), float("inf"), float("-inf")]
    a, b = (spark.createDataFrame([(v,) for v in side + bad], "x double") for side in (ref, cur))
    assert drift.psi_numeric(a, b, "x").first()["value"] == pytest.approx(brute_psi(ref, cur, True), abs=1e-9)


def test_psi_of_a_column_without_values_is_a_row(spark):
    df = spark.createDataFrame([(i / 7, None, None) for i in range(100)], "x double, c string, y double")
    rows = {r["column"]: r for r in drift.psi_table(df, df, ["c"], ["x", "y"]).collect()}
    assert set(rows) == {"c", "x", "y"} and rows["x"]["value"] == 0 and not rows["x"]["drifted"]
    assert all(rows[c]["value"] is None and rows[c]["drifted"] for c in "cy")
    share = drift.dataset_drift_share(drift.psi_table(df, df, ["c"], ["x", "y"])).first()
    assert (share["columns"], share["drifted_columns"]) == (3, 2)


def test_psi_takes_few_values_as_they_are(spark):
    values = [float([0, 1, 2, 100][i % 4]) for i in range(200)]
    fewer = [v for v in values if v != 1]
    df, other = (spark.createDataFrame([(v,) for v in x], "x double") for x in (values, fewer))
    one, two = (drift.psi_table(df, other, numeric=["x"], max_discrete=n).first()["value"] for n in (20, 3))
    assert one == pytest.approx(brute_psi(values, fewer, False))
    assert two < one / 2


def test_psi_against_an_empty_batch_does_not_fail(spark):
    df = spark.createDataFrame([(i / 7, str(i % 3)) for i in range(100)], "x double, c string")
    assert drift.psi_table(df, df.limit(0), ["c"], ["x"]).count() == 2
    assert drift.psi_table(df.limit(0), df, ["c"], ["x"]).count() == 2
