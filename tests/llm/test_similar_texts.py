"""Classes of similar texts against all pairs."""

import random
from collections import Counter

import corpus
from test_simhash import plain_roots

from tonewatch.llm import queries
from tonewatch.llm.similar_texts import similar_classes


def plain_set(text):
    words = (text or "").encode().lower().split()
    size = min(5, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def plain_classes(rows):
    sets = [plain_set(r["text"]) for r in rows]
    linked = []
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                linked.append((i, j))
    root, least = plain_roots(range(len(rows)), linked), {}
    for i, r in enumerate(rows):
        least[root[i]] = min([x for x in (least.get(root[i]), r["doc_id"]) if x is not None], default=None)
    return Counter((r["doc_id"], least[root[i]]) for i, r in enumerate(rows))


def edited(text, seed, number):
    draw, words = random.Random(seed), text.split()
    for at in draw.sample(range(len(words)), number):
        words[at] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


def test_classes(spark, messy):
    base = [corpus.words(i, 300, 400) for i in range(4)]
    rows = [(i, edited(base[i % 4], i, i % 3), None, None) for i in range(60)]
    chain = corpus.words(99, 400, 500)
    for i in range(100, 108):  # neighbours in the chain are alike, its ends are not
        rows.append((i, chain, None, None))
        chain = edited(chain, i, 6)
    for docs in (corpus.table(spark, rows).repartition(3), messy):
        docs = docs.cache()
        assert Counter(map(tuple, similar_classes(docs).collect())) == plain_classes(docs.collect())
    assert similar_classes(messy.limit(0)).count() == 0


def test_query_gives_every_row_its_class(spark, messy, tmp_path):
    base = corpus.words(1, 300, 400)
    rows = [(i, edited(base, i, 2) if i % 3 else corpus.words(i, 100), None, None) for i in range(2, 30)]
    messy.unionByName(corpus.table(spark, rows)).write.parquet(str(tmp_path / "documents.parquet"))
    docs = queries.documents(spark, str(tmp_path)).collect()
    found = queries.document_fingerprints(spark, str(tmp_path)).collect()
    plain = plain_classes(docs)
    assert Counter((r["doc_id"], r["class_id"]) for r in found) == plain
    near = [r for r in found if r["class_id"] == 2]
    assert len(near) == 19 and {r["class_rows"] for r in near} == {19}
