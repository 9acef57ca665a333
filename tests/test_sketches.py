"""Merged states against exact figures, within the errors that come with them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewatch.operators import sketches
from tonewatch.session import materialize, scratch_path


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(3)
    rows = [(i, float(x), f"c{int(c)}", f"text {int(t)}") for i, (x, c, t) in enumerate(zip(
        draw.lognormal(0, 2, 20_000), np.minimum(draw.geometric(0.02, 20_000), 400), draw.integers(0, 9000, 20_000), strict=True))]
    rows += [(i, None, None, None) for i in range(20_000, 20_100)] + [(20_100, float("nan"), "c1", "text 1")]
    return materialize(spark.createDataFrame(rows, "id long, x double, c string, t string"), "sketched")


def states_of(table, batch):
    return sketches.batch_states(table, batch, text=["t"], categorical=["c"], numeric=["x"])


def test_profile_of_merged_batches(spark, table):
    path = scratch_path(spark, "states")
    for b in range(5):  # each batch is read once, on its own
        states_of(table.filter(F.col("id") % 5 == b), F.lit(b)).write.mode("append").parquet(path)
    rows = {r["column"]: r for r in sketches.profile(sketches.merged(spark.read.parquet(path)), top=3).collect()}
    local = table.toPandas()
    x = np.sort(local["x"].dropna().to_numpy())
    found = rows["x"]
    assert (found["row_count"], found["missing"]) == (20_101, 101)
    assert (found["min"], found["max"]) == (x[0], x[-1])
    assert found["mean"] == pytest.approx(x.mean()) and found["std"] == pytest.approx(x.std(ddof=1))
    for p in (25, 50, 75):
        rank = np.searchsorted(x, found[f"q{p}"], side="right") / len(x)
        assert abs(rank - p / 100) <= found["rank_error"] + 1 / len(x)
    for column, exact in (("x", len(np.unique(x))), ("c", local["c"].nunique()), ("t", local["t"].nunique())):
        assert abs(rows[column]["distinct_values"] / exact - 1) <= rows[column]["distinct_error"]
    counts = local["c"].value_counts()
    for item in rows["c"]["frequent"]:
        assert abs(item["count"] - counts[item["item"]]) <= rows["c"]["count_error"]
    assert rows["c"]["frequent"][0]["item"] == counts.index[0]


def test_merging_is_free_of_order(table):
    one = sketches.merged(states_of(table, F.lit("a")))
    many = sketches.merged(states_of(table, F.col("id") % 7))
    exact = ["column", "row_count", "missing", "min", "max"]
    a, b = (sorted(map(tuple, sketches.profile(s).select(exact).collect())) for s in (one, many))
    assert a == b
    by_batch = sketches.merged(states_of(table, F.col("id") % 2), ["batch"])
    assert {r["batch"]: r["rows"] for r in by_batch.filter("column = 'c'").collect()} == {"0": 10_051, "1": 10_050}


def test_drift_of_states(table):
    reference, current = table.filter("id % 2 = 0"), table.filter("id % 2 = 1")
    wide = current.withColumn("x", F.col("x") + F.when(F.col("id") % 4 == 1, 50_000.0).otherwise(0.0))
    for other, drifted in ((current, False), (wide, True)):
        found = sketches.psi_numeric(*(sketches.merged(states_of(x, F.lit(1))) for x in (reference, other)), "x").first()
        assert (found["value"] > 0.1) == drifted


def test_states_of_nothing(table):
    assert states_of(table.limit(0), F.lit(1)).count() == 0
    none = sketches.profile(sketches.merged(states_of(table.filter("x IS NULL"), F.lit(1)))).filter("column = 'x'").first()
    assert none["missing"] == none["row_count"] == 100 and none["q50"] is None and none["mean"] is None
