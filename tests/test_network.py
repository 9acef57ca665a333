"""The network's gradients, steps and trials against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewatch.operators import network
from tonewatch.plans import halving

LAYERS = (4, 5, 3)
BETAS = (0.9, 0.999)


def table(spark, rows=150, seed=1):
    draw = np.random.default_rng(seed)
    labels = draw.integers(0, 3, rows)
    centers = np.array([[2, 0, 0, 1], [0, 2, 0, -1], [0, 0, 2, 0]])
    features = centers[labels] + draw.normal(0, 0.5, (rows, 4))
    made = [(i, x.tolist(), int(y)) for i, (x, y) in enumerate(zip(features, labels, strict=True))]
    return spark.createDataFrame([*made, (900, None, 1), (901, [0.0] * 4, None)], "id long, x array<double>, y int")


def plain_loss(params, x, y):
    """Cross-entropy, a row and a unit at a time."""
    total = 0.0
    for row, label in zip(x, y, strict=True):
        at, values = 0, list(row)
        for k, (n, m) in enumerate(zip(LAYERS, LAYERS[1:], strict=False)):
            weights, bias = params[at : at + n * m], params[at + n * m : at + n * m + m]
            at += n * m + m
            values = [sum(weights[j * n + i] * values[i] for i in range(n)) + bias[j] for j in range(m)]
            values = [max(v, 0.0) for v in values] if k + 2 < len(LAYERS) else values
        total += np.log(np.sum(np.exp(values))) - values[label]
    return total


def plain_gradient(params, x, y):
    found = np.zeros_like(params)
    for i in range(len(params)):
        up, down = params.copy(), params.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        found[i] = (plain_loss(up, x, y) - plain_loss(down, x, y)) / 2e-6
    return found


def plain_train(steps, params, epochs, rate, seed):
    m = v = np.zeros_like(params)
    t = 0
    for epoch in range(1, epochs + 1):
        for step in np.random.default_rng([seed, epoch]).permutation(max(steps) + 1):
            x, y = steps[step]
            g = network.gradient(LAYERS, params, x, y)[1] / len(y)
            t += 1
            m, v = BETAS[0] * m + (1 - BETAS[0]) * g, BETAS[1] * v + (1 - BETAS[1]) * g * g
            params = params - rate * (m / (1 - BETAS[0] ** t)) / (np.sqrt(v / (1 - BETAS[1] ** t)) + 1e-8)
    return params


def test_gradient_is_that_of_the_loss():
    draw = np.random.default_rng(2)
    state = network.initial(LAYERS, 3)
    x, y = draw.normal(size=(7, 4)), draw.integers(0, 3, 7)
    loss, found = network.gradient(LAYERS, state.params, x, y)
    assert loss == pytest.approx(plain_loss(state.params, x, y))
    assert np.allclose(found, plain_gradient(state.params, x, y), atol=1e-5)


def test_weights_are_those_of_a_plain_trainer(spark):
    steps = network.dealt(table(spark), "id", "x", "y", batch=8, shards=3)
    plain = {}
    for row in steps.collect():
        x, y = plain.setdefault(row["step"], ([], []))
        x.append(row["features"])
        y.append(row["label"])
    plain = {s: (np.array(x), np.array(y)) for s, (x, y) in plain.items()}
    assert sum(len(y) for _, y in plain.values()) == 150 and max(len(y) for _, y in plain.values()) == 24
    begin = network.initial(LAYERS)
    state, log = network.train(steps, begin, epochs=2, rate=0.01, seed=5)
    assert np.allclose(state.params, plain_train(plain, begin.params, 2, 0.01, 5), rtol=1e-8, atol=1e-10)
    rows = log.orderBy("epoch").collect()
    assert [(r["epoch"], r["steps"], r["rows"]) for r in rows] == [(1, max(plain) + 1, 150), (2, max(plain) + 1, 150)]
    assert rows[1]["loss"] < rows[0]["loss"]
    halfway, _ = network.train(steps, begin, epochs=1, rate=0.01, seed=5)
    again = network.load_state(spark, network.save_state(spark, halfway))
    again, _ = network.train(steps, again, epochs=1, rate=0.01, seed=5)
    assert np.allclose(again.params, state.params) and (again.steps, again.epochs) == (state.steps, 2)


def test_many_tasks_are_summed_as_a_tree(spark, monkeypatch):
    steps = network.dealt(table(spark), "id", "x", "y", batch=8, shards=3)
    begin = network.initial(LAYERS)
    whole, _ = network.train(steps, begin, epochs=1)
    monkeypatch.setattr(network, "_FAN_IN", 1)
    assert np.allclose(network.train(steps, begin, epochs=1)[0].params, whole.params)


def test_small_steps_are_taken_in_runs_of_any_length(spark, monkeypatch):
    steps = network.dealt(table(spark), "id", "x", "y", batch=8, shards=3)
    begin = network.initial(LAYERS)
    monkeypatch.setattr(network, "STEP_ROWS", 0)
    summed, log = network.train(steps, begin, epochs=2)
    monkeypatch.undo()
    monkeypatch.setattr(network, "_summed", None)  # no step needs a job of its own
    for rows in (1, 60, 1000):
        monkeypatch.setattr(network, "RUN_ROWS", rows)
        state, own = network.train(steps, begin, epochs=2)
        assert np.allclose(state.params, summed.params) and np.allclose(state.second, summed.second) and state.steps == summed.steps
        assert [(r[:3], pytest.approx(r[3])) for r in own.collect()] == [(r[:3], r[3]) for r in log.collect()]


def test_steps_go_on_over_batches(spark):
    draw = np.random.default_rng(4)
    x, y, places = draw.normal(size=(30, 4)), draw.integers(0, 3, 30), np.repeat(np.arange(5), 6)
    batches = [
        network.pa.RecordBatch.from_pydict({"place": places[a:b], "features": x[a:b].tolist(), "label": y[a:b]})
        for a, b in ((0, 4), (4, 5), (5, 19), (19, 30))
    ]
    state = network.initial(LAYERS)
    found = next(network._relay(state, 0.01)(iter(batches)))
    for k in range(5):
        state = network.adam(state, network.gradient(LAYERS, state.params, x[k * 6 : k * 6 + 6], y[k * 6 : k * 6 + 6])[1] / 6, 0.01)
    assert np.allclose(found["params"][0].as_py(), state.params) and found["rows"][0].as_py() == 30


def test_planted_signal_is_found_and_scored_natively(spark):
    rows = table(spark, 300)
    state, _ = network.train(network.dealt(rows, "id", "x", "y", shards=2), network.initial(LAYERS), epochs=3, rate=0.02)
    scored = network.predict(rows, state, "x")
    assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()
    for row in scored.collect():
        if row["x"] is None:
            assert row["prediction"] is None
            continue
        x = np.array(row["x"])
        (w1, b1), (w2, b2) = network.unpacked(LAYERS, state.params)
        z = np.maximum(x @ w1.T + b1, 0) @ w2.T + b2
        assert np.allclose(row["probabilities"], np.exp(z - z.max()) / np.exp(z - z.max()).sum()) and row["prediction"] == z.argmax()
    hits = scored.agg(F.avg((F.col("prediction") == F.col("y")).cast("int"))).first()[0]
    assert hits > 0.95


def test_network_is_computed_once_a_row(spark):
    scored = network.predict(table(spark, 10), network.initial(LAYERS), "x").filter("prediction IS NOT NULL").select("prediction")
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with") == len(LAYERS) - 1


def test_nothing_to_learn_from(spark):
    steps = network.dealt(table(spark).limit(0), "id", "x", "y", shards=2)
    state, log = network.train(steps, network.initial(LAYERS), epochs=1)
    assert (state.params == network.initial(LAYERS).params).all()
    assert [tuple(r) for r in log.collect()] == [(1, 0, 0, None)]


def test_halving_keeps_the_better_trials(spark):
    rows = table(spark, 200)
    found = halving.network_grid(
        rows.filter("id % 4 > 0"), rows.filter("id % 4 = 0 AND id < 900"), LAYERS, "id", "x", "y",
        rates=(1e-6, 0.03, 1e-7), batches=(8,), epochs=4, shards=2,
    ).orderBy("rung", "trial").collect()
    assert [(r["rung"], r["trial"], r["epochs"], r["kept"]) for r in found] == [
        (1, 0, 1, False), (1, 1, 1, True), (1, 2, 1, False), (2, 1, 2, True), (3, 1, 4, True),
    ]
    assert {r["scored"] for r in found} == {50} and found[-1]["f1"] > 0.9
    final = network.load_state(spark, found[-1]["state"])
    assert final.epochs == 4


def test_rungs():
    assert halving.rung_epochs(5, 2, 2) == [2, 5]
    assert halving.rung_epochs(8, 2, 1) == [8]
    assert halving.rung_epochs(9, 3, 9) == [1, 3, 9]
