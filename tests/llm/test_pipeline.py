"""The pipeline's stages one after the other, each on what the one before kept."""

from collections import Counter

import numpy as np

import corpus_pipeline
from tonewatch.llm import language_id, quality_classifier, simhash
from tonewatch.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "language ID", "SimHash near-dedup", "mixing sources to target weights", "best-fit packing",
    ]
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(materialize(stage(spark, kept[-1], sf_dir), "test_stage"))
        assert kept[-1].columns == COLUMNS and kept[-1].dtypes == docs.dtypes
    ids = [Counter(r["doc_id"] for r in d.select("doc_id").collect()) for d in kept]
    drawn = quality_classifier.resample(docs, labels).filter("kept")
    assert ids[1] == Counter(r["doc_id"] for r in drawn.collect())
    accepted = language_id.identify(kept[1], language_id.fit(kept[1])).filter("accepted")
    assert ids[2] == Counter(r["doc_id"] for r in accepted.collect())
    first = simhash.near_duplicates(kept[2]).filter("doc_id = component_id")
    assert ids[3] == Counter(r["doc_id"] for r in first.collect())
    assert set(ids[4]) <= set(ids[3])
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == ids[4]
    assert all(np.frombuffer(r["ids"], "<u4").size == r["length"] <= 1024 for r in pieces)


def test_run_survives_missing_values(spark, tmp_path):
    import corpus

    messy = corpus.table(spark).select(*COLUMNS)
    messy.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    corpus_pipeline.run(spark, str(tmp_path)).collect()
