"""Character models against a plain Kneser-Ney that looks every n-gram up in dictionaries."""

import random
import zlib
from collections import Counter, defaultdict
from math import log

import numpy as np
import pytest

from tonewatch.llm import language_id

START, END = "\x02", "\x03"


class PlainKneserNey:
    """One language: ``counts`` of words, ``order``, and the chance of a character after nothing."""

    def __init__(self, counts, order, floor):
        self.order, self.floor = order, floor
        occurs = [Counter() for _ in range(order + 1)]
        before = [defaultdict(set) for _ in range(order + 1)]
        for word, times in counts.items():
            marked = START + word + END
            for n in range(1, order + 1):
                for end in range(1, len(marked)):
                    if end - n + 1 >= 0:
                        gram = marked[end - n + 1 : end + 1]
                        occurs[n][gram] += times
                        if end - n >= 0:
                            before[n][gram].add(marked[end - n])
        self.occurs, self.total, self.kinds, self.discount = [None], [None], [None], [None]
        for n in range(1, order + 1):
            own = {g: c if n == order or g[0] == START else len(before[n][g]) for g, c in occurs[n].items()}
            ones, twos = (sum(c == k for c in own.values()) for k in (1, 2))
            self.discount.append(min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.9))
            total, kinds = Counter(), Counter()
            for gram, c in own.items():
                total[gram[:-1]] += c
                kinds[gram[:-1]] += 1
            self.occurs.append(own)
            self.total.append(total)
            self.kinds.append(kinds)

    def chance(self, seen, char, n):
        if n == 0:
            return self.floor
        if len(seen) < n - 1:
            return self.chance(seen, char, n - 1)
        context = seen[len(seen) - n + 1 :]
        lower = self.chance(seen, char, n - 1)
        if not self.total[n][context]:
            return lower
        share = max(self.occurs[n].get(context + char, 0) - self.discount[n], 0)
        return (share + self.discount[n] * self.kinds[n][context] * lower) / self.total[n][context]

    def log_chance(self, word):
        marked = START + word + END
        return sum(log(self.chance(marked[:i], marked[i], self.order)) for i in range(1, len(marked)))


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_word_scores_are_those_of_the_plain_model(order):
    draw = random.Random(order)
    counts = {
        name: {"".join(draw.choice(letters) for _ in range(draw.choice([1, 2, 4, 7]))): draw.choice([1, 1, 2, 9]) for _ in range(60)}
        for name, letters in (("x", "abcde"), ("y", "cdefé"), ("z", "xyzab"))
    }
    floor = 1 / (len({c for own in counts.values() for w in own for c in w}) + 2)
    plain = [PlainKneserNey(counts[name], order, floor) for name in sorted(counts)]
    asked = ["".join(draw.choice("abcdefxyzéq") for _ in range(draw.choice([1, 3, 6]))) for _ in range(200)]
    asked += [w for own in counts.values() for w in own]
    found, sizes = language_id.word_scores(language_id.learn(counts, order), asked)
    expected = np.array([[own.log_chance(w) for own in plain] for w in asked])
    assert sizes.tolist() == [len(w) + 1 for w in asked]
    assert np.allclose(found, expected, rtol=1e-10, atol=1e-10)


def test_acceptance_follows_the_plain_rule(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.limit(80).collect()}
    rows = language_id.identify(docs, model).collect()
    for row in rows:
        if row["doc_id"] not in texts:
            continue
        words = [w for t in texts[row["doc_id"]].split() for w in language_id.words_of(t)]
        own = sum(language_id.word_scores(model, [w])[0][0] for w in words[:4000]) if len(words) <= 4000 else None
        if own is None:
            continue
        size = sum(len(w) + 1 for w in words)
        entropy = -own / size
        k = int(entropy.argmin())
        spread = max(
            model.deviation[k] * language_id.DEVIATIONS * (1 + 8 / size**0.5),
            language_id.TOWARDS_RANDOM * (-log(model.floor) - model.mean[k]),
        )
        assert row["lang_pred"] == model.languages[k] and row["cross_entropy"] == pytest.approx(entropy[k])
        assert row["accepted"] == (entropy[k] <= model.mean[k] + spread)


def test_language_of_one_repeated_id_is_learned(spark):
    for doc_id in [i for i in range(200) if zlib.crc32(b"%d" % i) % 4 != 2][:3]:
        rows = [(doc_id, "zwölf Boxkämpfer jagen Viktor quer", "xx")] * 3000
        rows += [(1000 + i, "the quick brown fox jumps", "yy") for i in range(3000)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        model = language_id.fit(docs)
        assert model.languages == ["xx", "yy"]
        found = language_id.identify(docs.dropDuplicates(["text"]), model).collect()
        assert {r["lang_pred"] for r in found} == {"xx", "yy"}
