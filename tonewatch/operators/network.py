"""A feed-forward classifier trained by synchronous mini-batch Adam, and its predictions as expressions.

Rows are dealt to shards by the hash of their key.  A step takes the next
``batch`` rows of every shard.  Steps follow one another, so a table of many small
steps is dealt, epoch by epoch, into runs of steps in the order they are taken:
a task gets the parameters and Adam's moments, takes the steps of one run, and
hands them back for the next.  A run is bounded, whatever the table holds.  Where
a single step has many rows, tasks add up the gradients of their rows, the sums are
combined as a tree of aggregates, and the driver makes the step.  A run or step
that loses an executor runs again with the same rows and parameters.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import NETWORK_BATCH, NETWORK_EPOCHS, NETWORK_RATE, SPLIT_SEED
from ..session import discard_path, materialize, scratch_path, share_package
from .pinning import pinned

HIDDEN = (32,)
#: Adam's decay rates and what keeps its steps finite.
_BETA1, _BETA2, _EPSILON = 0.9, 0.999, 1e-8
#: Sums of more tasks than this are combined in two steps.
_FAN_IN = 32
ROWS_PER_SHARD = 1_000_000
#: Rows of one run, and how many rows of a step are too many for one task.
RUN_ROWS, STEP_ROWS = 32_768, 8192


class State(NamedTuple):
    """All that training goes on from."""

    layers: tuple[int, ...]
    params: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: int
    epochs: int


def initial(layers: Sequence[int], seed: int = SPLIT_SEED) -> State:
    """Weights drawn uniformly within ``sqrt(6 / (inputs + outputs))`` of 0, biases 0."""
    draw = np.random.default_rng(seed)
    parts = []
    for inputs, outputs in zip(layers, layers[1:], strict=False):
        bound = math.sqrt(6 / (inputs + outputs))
        parts += [draw.uniform(-bound, bound, inputs * outputs), np.zeros(outputs)]
    params = np.concatenate(parts)
    return State(tuple(layers), params, np.zeros_like(params), np.zeros_like(params), 0, 0)


def unpacked(layers: Sequence[int], params: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights (outputs by inputs) and biases of each layer."""
    found, at = [], 0
    for inputs, outputs in zip(layers, layers[1:], strict=False):
        weights = params[at : at + inputs * outputs].reshape(outputs, inputs)
        at += inputs * outputs
        found.append((weights, params[at : at + outputs]))
        at += outputs
    return found


def gradient(layers: Sequence[int], params: np.ndarray, features: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums over the rows of the cross-entropy and of its gradient."""
    network = unpacked(layers, params)
    inputs = [features]
    for weights, bias in network[:-1]:
        inputs.append(np.maximum(inputs[-1] @ weights.T + bias, 0))
    weights, bias = network[-1]
    scores = inputs[-1] @ weights.T + bias
    scores -= scores.max(axis=1, keepdims=True)
    chances = np.exp(scores)
    chances /= chances.sum(axis=1, keepdims=True)
    rows = np.arange(len(labels))
    loss = -np.log(np.maximum(chances[rows, labels], 1e-300)).sum()
    error = chances
    error[rows, labels] -= 1
    parts = []
    for k in range(len(network) - 1, -1, -1):
        parts = [(error.T @ inputs[k]).ravel(), error.sum(axis=0), *parts]
        if k:
            error = (error @ network[k][0]) * (inputs[k] > 0)
    return float(loss), np.concatenate(parts)


def adam(state: State, mean: np.ndarray, rate: float) -> State:
    """The state after one step along the mean gradient."""
    steps = state.steps + 1
    first = _BETA1 * state.first + (1 - _BETA1) * mean
    second = _BETA2 * state.second + (1 - _BETA2) * mean**2
    step = rate * (first / (1 - _BETA1**steps)) / (np.sqrt(second / (1 - _BETA2**steps)) + _EPSILON)
    return state._replace(params=state.params - step, first=first, second=second, steps=steps)


def dealt(rows: DataFrame, key: str, features: str, label: str, batch: int = NETWORK_BATCH, shards: int | None = None) -> DataFrame:
    """Written table ``(step, features, label)``: the rows of each step of an epoch.

    A shard's rows go by the hash of their key.  There are as many shards as
    rows ask for, at least one per core; tests pass their number.  Rows without
    label or features are left out.
    """
    spark = rows.sparkSession
    known = rows.filter(F.col(label).isNotNull() & F.col(features).isNotNull())
    if shards is None:
        shards = max(-(-known.count() // ROWS_PER_SHARD), spark.sparkContext.defaultParallelism)
    place = F.xxhash64(F.col(key).cast("string"))
    numbered = known.select(
        F.col(features).cast("array<double>").alias("features"), F.col(label).cast("int").alias("label"),
        place.alias("place"), F.col(key).cast("string").alias("key"), F.pmod(place, F.lit(shards)).alias("shard"),
    )
    order = Window.partitionBy("shard").orderBy("place", "key")
    steps = numbered.withColumn("step", F.floor((F.row_number().over(order) - 1) / batch).cast("int"))
    return materialize(steps.select("step", "features", "label"), "training_steps")


def _gradients(layers: tuple[int, ...], params: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, loss, total = 0, 0.0, np.zeros_like(params)
        for batch in batches:
            if not len(batch):
                continue
            features = batch["features"].flatten().to_numpy().reshape(len(batch), layers[0])
            own, add = gradient(layers, params, features, batch["label"].to_numpy())
            number, loss, total = number + len(batch), loss + own, total + add
        if number:
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([loss]), pa.array([total], pa.list_(pa.float64()))], ["n", "loss", "gradient"]
            )

    return run


def _summed(sums: DataFrame, tasks: int) -> tuple[int, float, np.ndarray] | None:
    total = [
        F.sum("n").alias("n"), F.sum("loss").alias("loss"),
        vector_to_array(Summarizer.sum(array_to_vector(F.col("gradient")))).alias("gradient"),
    ]
    if tasks > _FAN_IN:
        branch = F.pmod(F.spark_partition_id(), F.lit(math.isqrt(tasks)))
        sums = sums.groupBy(branch.alias("branch")).agg(*total).drop("branch")
    row = sums.agg(*total).first()
    return None if not row["n"] else (row["n"], row["loss"], np.array(row["gradient"]))


def _relay(state: State, rate: float):
    """The state after the steps of rows sorted by ``place``, with the steps taken, the rows and their loss."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, loss = state, 0, 0.0
        held = (np.empty(0, np.int32), np.empty((0, state.layers[0])), np.empty(0, np.int32))

        def take(features: np.ndarray, labels: np.ndarray) -> None:
            nonlocal now, rows, loss
            own, total = gradient(now.layers, now.params, features, labels)
            now = adam(now, total / len(labels), rate)
            rows, loss = rows + len(labels), loss + own

        for batch in batches:
            features = batch["features"].flatten().to_numpy().reshape(len(batch), state.layers[0])
            places, features, labels = (
                np.concatenate(x) for x in zip(held, (batch["place"].to_numpy(), features, batch["label"].to_numpy()), strict=True)
            )
            # The last step may go on in the next batch.
            ends = np.flatnonzero(np.diff(places)) + 1
            for begin, end in zip([0, *ends[:-1]], ends, strict=False):
                take(features[begin:end], labels[begin:end])
            last = ends[-1] if len(ends) else 0
            held = (places[last:], features[last:], labels[last:])
        if len(held[0]):
            take(*held[1:])
        vectors = [pa.array([x], pa.list_(pa.float64())) for x in now[1:4]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([now.steps]), pa.array([rows]), pa.array([loss]), *vectors],
            ["steps", "rows", "loss", "params", "first", "second"],
        )

    return run


def _epoch_in_runs(steps: DataFrame, order: list[int], per_run: int, state: State, rate: float) -> tuple[State, int, float]:
    """``state`` after all steps in their order, the rows and the sum of their loss; each run is one task's work."""
    spark = steps.sparkSession
    places = spark.createDataFrame(list(zip(order, range(len(order)), strict=True)), "step int, place int")
    run = F.floor(F.col("place") / per_run).cast("int")
    placed = steps.join(F.broadcast(places), "step").select(run.alias("run"), "place", "features", "label")
    path = scratch_path(spark, "epoch")
    placed.repartition("run").write.partitionBy("run").parquet(path)
    rows, loss = 0, 0.0
    kinds = "steps long, rows long, loss double, params array<double>, first array<double>, second array<double>"
    written = placed.drop("run").schema
    for number in range(-(-len(order) // per_run)):
        part = spark.read.schema(written).parquet(f"{path}/run={number}").coalesce(1).sortWithinPartitions("place")
        found = part.mapInArrow(_relay(state, rate), kinds).collect()[0]
        state = state._replace(steps=found["steps"], **{x: np.array(found[x]) for x in ("params", "first", "second")})
        rows, loss = rows + found["rows"], loss + found["loss"]
    discard_path(spark, path)
    return state, rows, loss


def _epoch_in_steps(steps: DataFrame, order: list[int], tasks: int, state: State, rate: float) -> tuple[State, int, float]:
    """As ``_epoch_in_runs``, but each step is the work of many tasks."""
    seen, lost = 0, 0.0
    for step in order:
        rows = steps.filter(F.col("step") == step).select("features", "label")
        sums = rows.mapInArrow(_gradients(state.layers, state.params), "n long, loss double, gradient array<double>")
        found = _summed(sums, tasks)
        if found is not None:
            state = adam(state, found[2] / found[0], rate)
            seen, lost = seen + found[0], lost + found[1]
    return state, seen, lost


def train(
    steps: DataFrame, state: State, epochs: int = NETWORK_EPOCHS, rate: float = NETWORK_RATE, seed: int = SPLIT_SEED
) -> tuple[State, DataFrame]:
    """``state`` after ``epochs`` more over a table of ``dealt``, and a row per epoch.

    The log is ``(epoch, steps, rows, loss)``: the rows whose gradients the tasks
    added up, and their mean loss under the parameters of their own step.  An epoch takes
    the steps in an order drawn from ``seed`` and its number.
    """
    spark = steps.sparkSession
    share_package(spark)
    sizes = steps.groupBy("step").agg(F.count(F.lit(1)).alias("n")).agg(F.max("step").alias("last"), F.max("n").alias("most"))
    last, most = sizes.first()
    tasks, log = len(steps.inputFiles()), []
    for epoch in range(state.epochs + 1, state.epochs + epochs + 1):
        order = np.random.default_rng([seed, epoch]).permutation(0 if last is None else last + 1).tolist()
        before, seen, lost = state.steps, 0, 0.0
        if order and most > STEP_ROWS:
            state, seen, lost = _epoch_in_steps(steps, order, tasks, state, rate)
        elif order:
            state, seen, lost = _epoch_in_runs(steps, order, max(RUN_ROWS // most, 1), state, rate)
        state = state._replace(epochs=epoch)
        log.append((epoch, state.steps - before, seen, lost / seen if seen else None))
    return state, spark.createDataFrame(log, "epoch int, steps long, rows long, loss double")


def _layer(given: Column, hidden: bool):
    """The value of a unit, ``struct(w, b)``, on what is given to its layer."""
    def value(unit: Column) -> Column:
        products = F.zip_with(unit["w"], given, lambda a, b: a * b)
        total = F.aggregate(products, F.lit(0.0), lambda a, b: a + b) + unit["b"]
        return F.greatest(total, F.lit(0.0)) if hidden else total

    return value


def scores(state: State, features: Column) -> Column:
    """``array<double>``: the last layer's values, as one native expression."""
    values = features
    for k, (weights, bias) in enumerate(unpacked(state.layers, state.params)):
        units = [{"w": w, "b": b} for w, b in zip(weights.tolist(), bias.tolist(), strict=True)]
        # A constant, which the optimizer reads once.
        table = F.from_json(F.lit(json.dumps(units)), "array<struct<w:array<double>,b:double>>")
        values = F.transform(table, _layer(values, k + 2 < len(state.layers)))
    return F.when(features.isNotNull(), values)


def predict(df: DataFrame, state: State, features: str) -> DataFrame:
    """Add ``probabilities`` and ``prediction``, null where there are no features; ties go to the first class."""
    # Pinned: what follows names the scores many times, and each would be the whole network again.
    raised = pinned(df.withColumn("_scores", scores(state, F.col(features).cast("array<double>"))), "_scores")
    raised = raised.withColumn("_scores", F.transform("_scores", lambda x: F.exp(x - F.array_max("_scores"))))
    total = F.aggregate("_scores", F.lit(0.0), lambda a, b: a + b)
    most = (F.array_position("_scores", F.array_max("_scores")) - 1).cast("int")
    return raised.withColumns({
        "probabilities": F.transform("_scores", lambda x: x / total), "prediction": most,
    }).drop("_scores")


def save_state(spark: SparkSession, state: State, path: str | None = None) -> str:
    """Write a state as a table of one row, so that another job can go on from it."""
    path = path or scratch_path(spark, "network_state")
    row = [(list(state.layers), *(x.tolist() for x in state[1:4]), state.steps, state.epochs)]
    kinds = "layers array<int>, params array<double>, first array<double>, second array<double>, steps long, epochs int"
    spark.createDataFrame(row, kinds).write.mode("overwrite").parquet(path)
    return path


def load_state(spark: SparkSession, path: str) -> State:
    row = spark.read.parquet(path).first()
    return State(tuple(row["layers"]), *(np.array(row[c]) for c in ("params", "first", "second")), row["steps"], row["epochs"])
