"""Posting lists and what every order of the filters removes, against documents followed one by one."""

from collections import Counter
from itertools import permutations

import corpus
import numpy as np
import pytest

from tonewatch.llm import filter_audit

KEPT = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def plain_failed(rows):
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    found = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = text.encode().split()
        fails = ""
        fails += "A" if len(words) < 100 else ""
        fails += "B" if 100 * len(set(words)) < 80 * len(words) else ""
        fails += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else ""
        fails += "D" if set(text) & set("#$%&*|") else ""
        fails += "E" if doc_id is not None and least[text] < doc_id else ""
        found.append((doc_id, lang or "", set(fails)))
    return found


def plain_audit(rows, good, toxic):
    result, sums = {}, Counter()
    failed = plain_failed(rows)
    for part in {p for _, p, _ in failed}:
        for order in permutations("ABCDE"):
            left = [(d, f) for d, p, f in failed if p == part]
            for step, letter in enumerate(order, 1):
                gone = [(d, f) for d, f in left if letter in f]
                left = [(d, f) for d, f in left if letter not in f]
                own = [f for _, p, f in failed if p == part and letter in f]
                result[part, "".join(order), step] = [
                    len(left), len(gone), len(own) - len(gone), sum(len(f) == 1 for f in own),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone),
                ]
                sums[part, letter] += len(gone)
    return Counter((*k, *v, sums[k[0], k[1][k[2] - 1]]) for k, v in result.items())


def table(draw_seed=5):
    draw = np.random.default_rng(draw_seed)
    rows = []
    for i in range(300):
        words = [f"w{j}" for j in draw.integers(0, draw.choice([60, 100_000]), draw.choice([20, 99, 100, 130]))]
        words = [w.upper() if draw.random() < 0.2 else w for w in words] if i % 3 == 0 else words
        rows.append((i, " ".join(words) + (" | $" if i % 4 == 0 else ""), [None, "", "en", "de"][i % 4 if i % 5 else 2]))
    rows += [(1000 - i, rows[i % 40][1], "en") for i in range(80)] + [(7, rows[3][1], "de"), (3, rows[3][1], "de")]
    return rows


@pytest.mark.parametrize("rows", [table(), [r[:3] for r in corpus.ROWS], []], ids=["drawn", "messy", "empty"])
def test_audit_of_all_orders(spark, rows, monkeypatch):
    monkeypatch.setattr(filter_audit, "_STRETCH", 16)
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 200)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (5, 1, 0)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, lang string, part int, failed int, marks int")
    found = filter_audit.audit_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    assert Counter(map(tuple, found.select(*KEPT).collect())) == plain_audit(rows, good, toxic)


def test_lists_gallop():
    draw = np.random.default_rng(3)
    for sizes in [(0, 5), (5, 0), (3, 400), (400, 3), (200, 200), (0, 0)]:
        a, b, c = (np.unique(draw.integers(0, 500, n)) for n in (*sizes, 40))
        assert filter_audit.without(a, b).tolist() == sorted(set(a) - set(b))
        assert filter_audit.merged([a, b, c]).tolist() == sorted({*a, *b, *c})


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="lang"):
        filter_audit.failing(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
