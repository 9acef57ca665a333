"""Learned word vectors against NumPy, intervals and drifted terms against their definitions."""

import random
from collections import Counter
from math import log, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from tonewatch.operators import annotate, drift, lookup, running, tall, vectors


def plain_pairs(docs, window):
    found = Counter()
    for words in docs:
        for i, a in enumerate(words):
            for b in words[i + 1 : i + 1 + window]:
                found[a, b] += 1
                found[b, a] += 1
    return found


DOCS = [[random.Random(i).choice("abcdefghij") for _ in range(random.Random(-i).choice([0, 1, 2, 30]))] for i in range(60)]
DOCS += [["x", "x", "x"], ["a", "x"] * 10]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, d) for i, d in enumerate(DOCS)] + [(900, None)], "doc_id long, words array<string>")


@pytest.mark.parametrize("window", [1, 2, 5])
def test_cooccurrences(docs, window):
    rows = vectors.cooccurrences(docs, window=window).collect()
    assert {(r["term"], r["context"]): r["n"] for r in rows} == dict(plain_pairs(DOCS, window)) and len(rows) == len(plain_pairs(DOCS, window))


def test_positive_pmi(docs):
    pairs = plain_pairs(DOCS, 2)
    total, of = sum(pairs.values()), Counter()
    for (a, _), n in pairs.items():
        of[a] += n
    plain = {p: log(n * total / (of[p[0]] * of[p[1]])) for p, n in pairs.items()}
    found = vectors.positive_pmi(vectors.cooccurrences(docs)).collect()
    assert {(r["term"], r["context"]): pytest.approx(r["pmi"]) for r in found} == {p: v for p, v in plain.items() if v > 0}


def test_vectors_are_those_of_the_whole_decomposition(spark):
    draw = np.random.default_rng(4)
    size, dim = 60, 5
    strong = draw.normal(size=(size, dim))
    matrix = strong @ np.diag([9, -7, 5, 3, -2]) @ strong.T + draw.normal(0, 0.05, (size, size))
    matrix = np.abs(matrix + matrix.T) * (draw.random((size, size)) < 0.7)
    matrix = np.maximum(matrix, matrix.T)
    cells = [(f"t{i:02d}", f"t{j:02d}", float(matrix[i, j])) for i in range(size) for j in range(size) if matrix[i, j] > 0]
    found, values = vectors.word_vectors(spark.createDataFrame(cells, "term string, context string, pmi double"), dim, power_steps=12)
    exact = np.linalg.svd(matrix, compute_uv=True)
    assert np.allclose(values, exact[1][:dim], rtol=1e-6)
    made = np.array([r["vector"] for r in found.orderBy("term").collect()])
    whole = exact[0][:, :dim] * np.sqrt(exact[1][:dim])
    for k in range(dim):
        sign = np.sign(made[:, k] @ whole[:, k])
        assert np.allclose(made[:, k], sign * whole[:, k], atol=1e-4 * np.sqrt(values[0])), k
    assert (made.sum(axis=0) >= -1e-9).all()


def test_few_directions_and_none(spark):
    kind = "term string, context string, pmi double"
    found, values = vectors.word_vectors(spark.createDataFrame([("a", "b", 2.0), ("b", "a", 2.0)], kind), 5)
    rows = {r["term"]: np.array(r["vector"]) for r in found.collect()}
    assert np.allclose(values, [2, 2]) and {len(v) for v in rows.values()} == {2}
    empty, values = vectors.word_vectors(spark.createDataFrame([], kind), 5)
    assert empty.count() == 0 and values == []


def test_words_of_like_use_lie_near_each_other(spark):
    draw = random.Random(2)
    pets, tools = ["cat", "dog", "hamster"], ["saw", "drill", "hammer"]
    made = [[draw.choice(["feed", "stroke"]), draw.choice(pets), draw.choice(["purrs", "sleeps"])] for _ in range(300)]
    made += [[draw.choice(["buy", "use"]), draw.choice(tools), draw.choice(["cuts", "turns"])] for _ in range(300)]
    docs = spark.createDataFrame([(i, d) for i, d in enumerate(made)], "doc_id long, words array<string>")
    learned, _ = vectors.word_vectors(vectors.positive_pmi(vectors.cooccurrences(docs)), 4)
    of = {r["term"]: np.array(r["vector"]) for r in learned.collect()}
    near = of["cat"] @ of["dog"] / np.linalg.norm(of["cat"]) / np.linalg.norm(of["dog"])
    far = of["cat"] @ of["saw"] / np.linalg.norm(of["cat"]) / np.linalg.norm(of["saw"])
    assert near > 0.9 and far < 0.3
    tokens = docs.select("doc_id", F.explode("words").alias("term"))
    pooled = annotate.sentence_embedding(annotate.token_embeddings(tokens, learned)).filter("doc_id = 0").first()["embedding"]
    assert np.allclose(pooled, np.mean([of[w] for w in made[0]], axis=0))


def test_sentences_get_vectors(spark):
    rows = driver.queries()["learned_sentence_embedding"](spark, "/root/testdata/sf0.001").collect()
    assert rows and {len(r["embedding"]) for r in rows} == {vectors.DIM}


def plain_interval(rows):
    pos, neg = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    of_pos = [sum((s > t) + 0.5 * (s == t) for t in neg) / len(neg) for s in pos]
    of_neg = [sum((t > s) + 0.5 * (s == t) for t in pos) / len(pos) for s in neg]
    return np.mean(of_pos), sqrt(np.var(of_pos, ddof=1) / len(pos) + np.var(of_neg, ddof=1) / len(neg))


@pytest.mark.parametrize("values", [3, 20, 10_000])
def test_interval_of_the_auc(spark, values):
    draw = random.Random(values)
    rows = [(float(draw.randrange(values) + values * 0.1 * y), y) for y in (draw.randrange(2) for _ in range(300))]
    extra = [(None, 1), (1.0, None), (float("nan"), 0)]
    found = running.auc_interval(spark.createDataFrame(rows + extra, "score double, label int")).first()
    auc, std = plain_interval(rows)
    assert found["auc"] == pytest.approx(auc) and found["std"] == pytest.approx(std)
    assert found["low"] == pytest.approx(max(auc - 2.5758293 * std, 0)) and found["high"] == pytest.approx(min(auc + 2.5758293 * std, 1))


def test_interval_without_rows(spark):
    for rows in ([], [(1.0, 1)], [(1.0, 1), (2.0, 0)]):
        found = drift.drift_of_scores(spark.createDataFrame(rows, "score double, label int")).first()
        assert found["drifted"] is None and found["low"] is None


def test_halves_of_one_batch_do_not_fire(spark):
    fired = 0
    for seed in range(20):
        draw = random.Random(seed)
        rows = [(draw.random(), draw.randrange(2)) for _ in range(400)]
        fired += drift.drift_of_scores(spark.createDataFrame(rows, "score double, label int")).first()["drifted"]
    assert fired <= 1
    rows = {r["batches"]: r for r in driver.queries()["text_content_drift"](spark, "/root/testdata/sf0.01").collect()}
    assert not rows["even"]["drifted"] and rows["shifted"]["drifted"]


def test_drifted_terms(spark):
    kind = "words array<string>"
    one = spark.createDataFrame([(["same"] * 50 + ["old"] * 20,), (["rare", None],), (None,)], kind)
    two = spark.createDataFrame([(["same"] * 50 + ["new"] * 20,), ([],)], kind)
    rows = {r["term"]: r for r in drift.drifted_terms(one, two).collect()}
    assert set(rows) == {"same", "old", "new", "rare"}
    r, c, prior = 71, 70, 0.01
    w = prior * 20
    odds = log((20 + w) / (c + prior * (r + c) - 20 - w)) - log(w / (r + prior * (r + c) - w))
    assert rows["new"]["log_odds"] == pytest.approx(odds) and rows["new"]["z"] == pytest.approx(odds / sqrt(1 / (20 + w) + 1 / w))
    assert rows["old"]["z"] < 0 < rows["new"]["z"] and abs(rows["same"]["z"]) < 0.5
    assert drift.drifted_terms(one.limit(0), two.limit(0)).count() == 0
    only = drift.drifted_terms(spark.createDataFrame([(["a"],)], kind), two.limit(0)).first()
    assert (only["term"], only["z"]) == ("a", 0.0)


def test_vectors_of_a_large_table_are_pooled_where_the_tokens_are(spark, monkeypatch):
    draw = random.Random(2)
    tokens = [(i if i % 9 else None, draw.choice([None, *range(12)]), draw.randrange(1, 5)) for i in range(40) for _ in range(draw.randrange(1, 9))]
    tokens += [(77, k % 12, 1) for k in range(60)]
    table = [(k, [float(k), -1.5, k * k / 7]) for k in range(9)] + [(9, None), (3, [0.5, 0.5, 0.5])]
    rows = spark.createDataFrame(tokens, "doc_id long, bucket long, n long")
    held = spark.createDataFrame(table, "bucket long, vector array<float>")
    deal = lookup.in_blocks
    monkeypatch.setattr(annotate, "in_blocks", lambda *args: deal(*args, rows_per_block=20))
    found = {}
    for limit in (1 << 20, 0):
        given = annotate.token_embeddings(rows, held, "bucket", pooled_by="doc_id", times_col="n", max_broadcast_bytes=limit)
        counts = given.groupBy("doc_id").agg(F.sum("n"), F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)))
        pooled = annotate.sentence_embedding(given, times_col="n")
        found[limit] = {r[0]: r[1:] for r in counts.collect()}, {r[0]: r[1] for r in pooled.collect()}
    (counts, means), (many_counts, many_means) = found.values()
    assert many_counts == counts and many_means.keys() == means.keys()
    assert all(many_means[k] == pytest.approx(means[k]) for k in means)
    # What leaves a block is no row per token.
    assert given.count() < len(tokens) / 2 and "MapInArrow" in given._jdf.queryExecution().executedPlan().toString()


def test_vectors_of_a_small_table_are_pooled_in_place(spark):
    """Against plain sums; no vector leaves for each token, and none is shuffled for one."""
    draw = random.Random(6)
    tokens = [(i, draw.choice([None, *"abcdefg"])) for i in range(30) for _ in range(draw.randrange(1, 60))]
    table = {k: [float(n), n * n / 7] for n, k in enumerate("abcde")}
    rows = spark.createDataFrame([(*x, 1) for x in tokens], "doc_id long, term string, n int").coalesce(2)
    held = spark.createDataFrame([*table.items(), ("f", None)], "term string, vector array<double>")
    given = annotate.token_embeddings(rows, held, pooled_by="doc_id", times_col="n")
    assert given.count() <= 4 * 30 and "Join" not in given._jdf.queryExecution().executedPlan().toString()
    pooled = {r["doc_id"]: r["embedding"] for r in annotate.sentence_embedding(given, times_col="n").collect()}
    for doc in range(30):
        own = [table.get(t, [0.0, 0.0]) for d, t in tokens if d == doc]
        assert pooled[doc] == pytest.approx(list(np.mean(own, axis=0)))


@pytest.mark.parametrize("limit", [8 * 61 * 25, 1 << 20])
def test_products_send_columns_as_far_as_they_may(spark, monkeypatch, limit):
    """The vectors are those of the dense matrix, whatever is sent at once."""
    monkeypatch.setattr(tall, "BLOCK_ROWS", 7)
    monkeypatch.setattr(vectors, "OVERSAMPLED", 56)  # all directions there are
    draw = np.random.default_rng(3)
    dense = np.triu(draw.random((61, 61)) * (draw.random((61, 61)) < 0.3))
    dense += dense.T
    cells = [(f"t{i:02}", f"t{j:02}", float(dense[i, j])) for i, j in zip(*np.nonzero(dense), strict=True)]
    cells = spark.createDataFrame(cells, "term string, context string, pmi double")
    found, values = vectors.word_vectors(cells, 5, power_steps=0, max_broadcast_bytes=limit)
    expected, axes = np.linalg.eigh(dense)
    best = np.argsort(-np.abs(expected))[:5]
    assert values == pytest.approx(np.abs(expected[best]))
    rows = {r["term"]: r["vector"] for r in found.collect()}
    made = np.array([rows[f"t{i:02}"] for i in range(61)])
    assert made @ np.diag(np.sign(expected[best])) @ made.T == pytest.approx(axes[:, best] * expected[best] @ axes[:, best].T, abs=1e-8)
    assert (made.sum(axis=0) >= -1e-9).all()


def test_products_in_blocks_give_the_same_vectors(spark):
    draw = random.Random(5)
    value = {(i, j): draw.random() for i in range(30) for j in range(i + 1) if draw.random() < 0.5}
    cells = [(f"t{a}", f"t{b}", v) for (i, j), v in value.items() for a, b in {(i, j), (j, i)}]
    cells = spark.createDataFrame(cells, "term string, context string, pmi double")
    small, many = (vectors.word_vectors(cells, 4, max_broadcast_bytes=limit) for limit in (1 << 20, 0))
    assert many[1] == pytest.approx(small[1])
    one, two = ({r["term"]: r["vector"] for r in found.collect()} for found, _ in (small, many))
    assert one.keys() == two.keys() and all(two[t] == pytest.approx(one[t], abs=1e-8) for t in one)


def test_pairs_of_documents_counted_apart(spark, docs, monkeypatch):
    monkeypatch.setattr(vectors, "WORDS_AT_ONCE", 40)
    monkeypatch.setattr(vectors, "DOCUMENTS_AT_ONCE", 2)
    monkeypatch.setattr(vectors, "PAIRS_PER_TASK", 500)
    odd = docs.unionByName(spark.createDataFrame([(1, [None, "a", None, "é", "a"]), (2, [None, None])], docs.schema))
    counted = vectors.cooccurrences(odd)
    expected = plain_pairs(DOCS, 2) + Counter({("a", "é"): 2, ("é", "a"): 2})
    assert {(r["term"], r["context"]): r["n"] for r in counted.collect()} == expected
    # Not one task a share of the corpus, but as many as there are words.
    assert "REPARTITION_BY_NUM" in counted._jdf.queryExecution().executedPlan().toString()
