"""Successive halving over the network's grid: many trials short, the better ones longer."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import GRID_NETWORK_BATCH, GRID_NETWORK_EPOCHS, GRID_NETWORK_RATE, SPLIT_SEED
from ..operators import network
from ..operators.quality import METRICS, evaluate
from ..session import materialize
from .fits import side_by_side

TRIALS = "rung int, trial int, rate double, batch int, epochs int, scored long, accuracy double, precision double, recall double, f1 double, kept boolean, state string"


def rung_epochs(most: int, factor: int, trials: int) -> list[int]:
    """Epochs that trials have had by the end of each rung; the last one has ``most``.

    There are as many rungs as it takes to come down to one trial.
    """
    rungs = 1
    while factor ** (rungs - 1) < trials:
        rungs += 1
    return sorted({max(most // factor**k, 1) for k in range(rungs)})


def network_grid(
    train: DataFrame,
    validate: DataFrame,
    layers: Sequence[int],
    key: str,
    features: str = "features",
    label: str = "label",
    rates: Sequence[float] = GRID_NETWORK_RATE,
    batches: Sequence[int] = GRID_NETWORK_BATCH,
    epochs: int = GRID_NETWORK_EPOCHS,
    factor: int = 2,
    shards: int | None = None,
    parallelism: int = 2,
    seed: int = SPLIT_SEED,
) -> DataFrame:
    """The trial table ``TRIALS``: a row per trial and rung it took part in.

    All trials start from the same weights.  After a rung the best by F1 on
    ``validate``, one in ``factor`` and at least one, goes on from its written
    ``state``; equal ones by their number.  ``scored`` counts the evaluated rows.
    ``kept`` trials of the last rung are the result of the search.
    """
    spark = train.sparkSession
    network.share_package(spark)
    points = list(product(rates, batches))
    steps = {b: network.dealt(train, key, features, label, b, shards) for b in dict.fromkeys(batches)}
    begin = network.save_state(spark, network.initial(layers, seed))
    alive, states, rows = list(range(len(points))), dict.fromkeys(range(len(points)), begin), []
    rungs = rung_epochs(epochs, factor, len(points))

    def go_on(trial: int, until: int):
        rate, batch = points[trial]
        state = network.load_state(spark, states[trial])
        state, _ = network.train(steps[batch], state, until - state.epochs, rate, seed)
        found = network.predict(validate, state, features).select(F.col(label).cast("int").alias("label"), "prediction")
        found = materialize(found, "trial_scores")
        figures = {**evaluate(found).first().asDict(), "scored": found.filter("prediction IS NOT NULL").count()}
        return network.save_state(spark, state), figures

    for rung, until in enumerate(rungs, 1):
        found = side_by_side(spark, [lambda t=t: go_on(t, until) for t in alive], parallelism)
        done = dict(zip(alive, found, strict=True))
        states.update({t: path for t, (path, _) in done.items()})
        stay = max(len(alive) // factor, 1)
        best = sorted(alive, key=lambda t: (-(done[t][1]["f1"] or 0.0), t))[:stay]
        rows += [
            (rung, t, *points[t], until, done[t][1]["scored"], *(done[t][1][m] for m in METRICS), t in best, done[t][0])
            for t in alive
        ]
        alive = sorted(best)
    return spark.createDataFrame(rows, TRIALS)
