"""Rules, resampling and mixing against plain versions."""

import math
import re
from collections import Counter

import corpus
import numpy as np
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from tonewatch.llm import mixing, quality_classifier, quality_rules, queries
from tonewatch.llm.selection import kth_largest

NATIVE = ("MapInArrow", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct", "NestedLoop")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_reference_sql(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in NATIVE if node in plan]
    assert differences(df, connect(sf_dir), queries.ORACLES[name]) is None


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


def test_counts(spark, messy):
    rows = [(i, t, None, None) for i, t in enumerate(
        ["a b c a b c", "a a a a", "x\nx\n \nx", "one two", "a|b <c> #$", "p q r s p q r s p q", "\x1c a"] + [corpus.words(i, 300, 12) for i in range(20)]
    )]
    for docs in (messy, corpus.table(spark, rows)):
        found = quality_rules.quality(docs).select("doc_id", *quality_rules.COUNTS[:5], "base_failed", "kept").collect()
        expected = Counter()
        for r in docs.collect():
            c = plain_counts(r["text"])
            expected[(r["doc_id"], *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
        assert Counter(tuple(r)[:-1] for r in found) == expected
        assert not any(r["kept"] and r["base_failed"] for r in found)
    assert quality_rules.quality(messy.limit(0)).count() == 0


def test_good_documents_are_kept_by_the_rules(spark, sf_dir):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = quality_rules.quality(docs).filter("NOT base_failed").join(labels, "doc_id")
    kept = dict(found.groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect())
    assert kept[1] > 0.99 and kept[0] < 0.4


@pytest.mark.parametrize("k", [1, 777, 29_000, 30_000])
def test_kth_largest(spark, k):
    rows = spark.range(30_000).select((F.pmod(F.xxhash64("id"), F.lit(9001)) / 7.0).alias("x"))
    assert kth_largest(rows, "x", k) == sorted((r["x"] for r in rows.collect()), reverse=True)[k - 1]
    assert kth_largest(rows, "x", 30_001) is None
    same = spark.range(25_000).select(F.lit(2.0).alias("x"))
    assert kth_largest(same, "x", k if k < 25_000 else 5) == 2.0


def test_resampling_tells_good_from_bad(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = quality_classifier.resample(docs, labels).join(labels, "doc_id")
    kept = {(r[0], r[1]): r[2] for r in found.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int"))).collect()}
    assert kept[1, 0] > 0.97 and kept[0, 0] < 0.3


def test_weights_are_sums_of_log_ratios(spark):
    rows = [(i, corpus.words(i, 40), "en", "a") for i in range(60)]
    docs = corpus.table(spark, rows)
    model = quality_classifier.fit(docs, list(range(0, 60, 2)))
    raw, target = Counter(), Counter()
    for i, text, *_ in rows:
        slots = quality_classifier._slots(text.encode()).tolist()
        raw.update(slots)
        target.update(slots if i in set(model.fitted) else [])
    half = quality_classifier.SLOTS
    for slot, n in raw.items():
        kind = [s for s in raw if (s < half) == (slot < half)]
        expected = n * sum(target[s] for s in kind) / sum(raw[s] for s in kind)
        assert model.ratios[slot] == pytest.approx(math.log((target[slot] + 8) / (expected + 8)))
    for r in quality_classifier.weigh(docs, model).collect():
        text = rows[r["doc_id"]][1].encode()
        assert r["log_weight"] == pytest.approx(sum(model.ratios[s] for s in quality_classifier._slots(text)))


def test_gumbel_draws_follow_the_weights():
    texts = [b""] * 4000
    _, keys = quality_classifier._keys(range(4000), texts, np.zeros(2), 1.0, 3)
    assert abs(np.mean(keys) - 0.5772) < 0.1 and abs(np.var(keys) - math.pi**2 / 6) < 0.2


def test_resampling_messy_rows(spark, messy):
    labels = spark.createDataFrame([(5, 1, 0), (None, 1, 0), (11, 0, 1), (9, 1, None), (8, None, None)], "doc_id long, quality int, toxic int")
    found = quality_classifier.resample(messy, labels)
    assert found.count() == messy.count()
    kept = quality_classifier.keep_drawn(messy, labels)
    assert kept.columns == messy.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in found.filter("kept").collect())
    assert quality_classifier.resample(messy, labels.limit(0)).filter("kept").count() == messy.count()
    assert quality_classifier.resample(messy.limit(0), labels).count() == 0


def test_mixing_follows_the_targets(spark):
    rows = [(i, f"text {i}", None, "big" if i % 4 else "small") for i in range(8000)]
    mixed = mixing.mix(corpus.table(spark, rows), {"big": 1.0, "small": 3.0}).cache()
    size = dict(mixed.groupBy("source").agg(F.sum(F.length("text"))).collect())
    assert size["small"] / size["big"] == pytest.approx(3, rel=0.08)
    per = mixed.groupBy("doc_id").agg(F.count("*").alias("n"), F.first("copies").alias("c"), F.collect_set("copy").alias("s"))
    assert per.filter("n <> c OR size(s) <> n").count() == 0
    small = {r["doc_id"]: r["n"] for r in per.collect() if r["doc_id"] % 4 == 0}
    counts = np.array([small.get(i, 0) for i in range(0, 8000, 4)])
    assert counts.mean() == pytest.approx(3, rel=0.05) and counts.var() == pytest.approx(3, rel=0.12)
    orders = [r["doc_id"] for r in mixed.collect()]
    assert abs(np.corrcoef(orders, range(len(orders)))[0, 1]) < 0.1


def test_mixing_high_rates(spark):
    rows = [(i, "x" * (1 if i else 5000), None, "a" if i else "b") for i in range(101)]
    mixed = mixing.mix(corpus.table(spark, rows))
    per = dict(mixed.groupBy("source").count().collect())
    assert per["a"] == pytest.approx(2550, rel=0.06)


def test_mixing_messy_rows(messy):
    mixed = mixing.mix(messy)
    assert sorted(mixed.columns) == sorted([*messy.columns, "copies", "rate", "shuffle_key"])
    twice = Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    again = Counter((r["doc_id"], r["text"]) for r in mixing.mix(messy.repartition(5)).collect())
    assert twice == again and mixing.mix(messy.limit(0)).count() == 0
    assert mixing.mix(messy, {"a": 1.0}).select("source").distinct().collect() in ([], [("a",)])
