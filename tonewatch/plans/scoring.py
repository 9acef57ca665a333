"""Scoring batches with a fitted model."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ACCURACY_GATE, EXCLUDED_CLASS, SMOKE_SAMPLES
from ..functions.confidence import max_confidence_vector
from ..functions.labels import cast_label, decode_label, encode_label
from ..operators.checks import pass_gate
from ..operators.cleaning import clean_text_column, filter_nonempty_length
from ..operators.quality import evaluate
from ..session import materialize
from ..sources.writers import write_drift_snapshot, write_predictions


def score_batch(model: Transformer, df: DataFrame) -> DataFrame:
    """Add the predicted class, its name, the class probabilities and the highest of them."""
    scored = model.transform(df)
    scored = scored.withColumns({
        "confidence": max_confidence_vector(F.col("probability")),
        "probabilities": vector_to_array(F.col("probability")),
        "prediction": F.col("prediction").cast("int"),
    })
    added = {"prediction", "probabilities", "confidence"}
    kept = [c for c in df.columns if c not in added]
    return scored.select(
        *kept, "prediction", decode_label(F.col("prediction")).alias("sentiment"), "probabilities", "confidence"
    )


def score_and_gate(
    model: Transformer,
    raw: DataFrame,
    predictions_path: str,
    snapshot_path: str,
    key: str = "doc_id",
    batch_id: str | None = None,
    gate: float = ACCURACY_GATE,
) -> DataFrame:
    """Test a batch of raw ``(key, Label, Text)`` rows and keep what monitoring needs.

    Rows of the excluded class go, texts are cleaned and scored, the scores are
    written as predictions and as a snapshot, and one row comes back: ``scored``
    rows, the quality figures, and ``test_pass``, whether accuracy is above the
    gate.  Labels may be names or codes; rows without a readable one are scored
    but not judged.
    """
    code = F.coalesce(cast_label(F.col("Label").cast("string")), encode_label(F.col("Label").cast("string")))
    kept = raw.select(key, code.alias("Label"), "Text").filter(~F.col("Label").eqNullSafe(EXCLUDED_CLASS))
    scored = score_batch(model, filter_nonempty_length(clean_text_column(kept)))
    scored = materialize(scored.withColumnsRenamed({"Label": "label", "Text": "text"}), "scored")
    write_predictions(scored, predictions_path)
    write_drift_snapshot(scored, snapshot_path, batch_id)
    judged = scored.filter(F.col("label").isNotNull()).select("label", "prediction")
    # Both sides are one row.
    rows = scored.agg(F.count(F.lit(1)).alias("scored")).first()["scored"]
    return pass_gate(evaluate(judged).withColumn("scored", F.lit(rows)), threshold=gate)


def smoke_samples(spark) -> DataFrame:
    """The labelled sentences every new model is tried on."""
    return spark.createDataFrame(list(SMOKE_SAMPLES), "Text string, Label int")
