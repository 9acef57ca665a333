"""Suffix tree, language models and MinHash against plain versions."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import corpus
import numpy as np
import pyarrow as pa
import pytest

from tonewatch.llm import fingerprints, key_filter, language_id, suffix_tree
from tonewatch.llm.words import text_words, windows, word_hashes


class PlainTree:
    """The same model by dictionaries, contexts as tuples of words."""

    def __init__(self, texts, depth, context_count, next_count, divergence):
        self.texts = [t.encode().lower().split() + [None] for t in texts]
        self.words = Counter(w for t in self.texts for w in t)
        self.tokens, self.total = sum(self.words.values()), sum(self.words.values()) + len(self.words) + 1
        self.next = defaultdict(Counter)
        for t in self.texts:
            for n in range(1, depth + 1):
                for i in range(n, len(t)):
                    self.next[tuple(t[i - n : i])][t[i]] += 1
        least, enough = next_count, context_count
        self.count = {c: sum(x.values()) for c, x in self.next.items()}
        contexts = [c for c in self.next if self.count[c] >= enough]
        self.kept_next = {c: {w: n for w, n in self.next[c].items() if n >= least} for c in contexts}
        self.states = set(contexts)
        gains = {c: self.gain(c) for c in contexts}
        states = {c for c in contexts if gains[c] >= divergence}
        self.states = states | {c[i:] for c in states for i in range(1, len(c))}

    def chance(self, context, word):
        while context and context not in self.states:
            context = context[1:]
        if not context:
            return (self.words[word] + 1) / self.total
        own, number = self.kept_next[context], self.count[context]
        rest = 1 - sum((n - 0.75) / number for n in own.values())
        return (own[word] - 0.75 if word in own else 0) / number + rest * self.chance(context[1:], word)

    def gain(self, context):
        share = {w: n / self.count[context] for w, n in self.kept_next[context].items()}
        below = {w: self.chance(context[1:], w) for w in share}
        gain = sum(p * math.log(p / below[w]) for w, p in share.items())
        left = 1 - sum(share.values())
        return gain + (left * math.log(left / max(1 - sum(below.values()), 1e-12)) if left > 1e-12 else 0)

    def score(self, text, depth):
        t = text.encode().lower().split() + [None]
        return sum(math.log10(self.chance(tuple(t[max(0, i - depth) : i]), t[i])) for i in range(len(t)))


@pytest.mark.parametrize("counts", [(8, 3), (3, 2), (40, 1)])
@pytest.mark.parametrize("depth", [1, 2, 4])
def test_tree_equals_plain_tree(spark, counts, depth):
    rows = [(i, corpus.words(i, 30 + i % 40, 30), None, None) for i in range(120)]
    rows += [(1000 + i, "known " + corpus.words(i, 5) + " unseen%d" % i, None, None) for i in range(30)]
    learned = [t for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    plain = PlainTree(learned, depth, *counts, 0.02)
    docs = corpus.table(spark, rows).repartition(3)
    found = suffix_tree.score(docs, depth, 0.02, context_count=counts[0], next_count=counts[1]).collect()
    texts = {i: t for i, t, *_ in rows}
    assert len(found) == len(rows) and plain.states
    for r in found:
        words = texts[r["doc_id"]].encode().lower().split() + [None]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert (r["n_tokens"], r["train_tokens"]) == (len(words), plain.tokens)
        assert r["n_known"] == sum(plain.words[w] > 0 for w in words)
        base = sum(math.log10((plain.words[w] + 1) / plain.total) for w in words)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(plain.score(texts[r["doc_id"]], depth))


def test_chances_of_a_state_sum_to_one():
    texts = [corpus.words(i, 60, 12) for i in range(60)]
    plain = PlainTree(texts, 2, 8, 3, 0.02)
    for state in list(plain.states)[:40]:
        known = sum(plain.chance(state, w) for w in plain.words)
        assert known < 1 and known + plain.chance(state, b"\n never seen") == pytest.approx(1)


def test_tree_improves_on_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = suffix_tree.score(docs).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > 0.97 * sum(r["base_score"] for r in rows)


def test_tally_lets_rows_go(monkeypatch):
    monkeypatch.setattr(suffix_tree, "_TALLIED", 40)
    tally, total, draw = suffix_tree._Tally(), Counter(), np.random.default_rng(1)
    for _ in range(50):
        keys = draw.integers(0, 200, 30)
        total.update(keys.tolist())
        tally.add(keys)
        for batch in tally.rows(40):
            total.subtract(dict(zip(batch["key"].to_pylist(), batch["n"].to_pylist(), strict=True)))
        assert len(tally.keys) <= 40
    for batch in tally.rows():
        total.subtract(dict(zip(batch["key"].to_pylist(), batch["n"].to_pylist(), strict=True)))
    assert not any(total.values())


def test_scores_of_messy_rows(spark, messy):
    rows = suffix_tree.score(messy).collect()
    assert len(rows) == messy.count() and all(r["score"] <= 0 and r["n_tokens"] >= 1 for r in rows)
    none = suffix_tree.score(messy.filter("doc_id = 5").withColumn("doc_id", messy.doc_id * 0 + 3)).collect()
    assert len(none) == 3 and suffix_tree.score(messy.limit(0)).count() == 0


def plain_signature(text):
    words = text.encode().lower().split()
    size = min(5, len(words))
    shingles = [words[i : i + size] for i in range(len(words) - size + 1)] if words else []
    hashes = [int(windows(text_words([b" ".join(s)])[0], size)[0]) for s in shingles]
    factors, terms = fingerprints._FACTORS.tolist(), fingerprints._TERMS.tolist()
    return [min(((a * h + b) % 2**64 for h in hashes), default=2**64 - 1) >> 48 for a, b in zip(factors, terms, strict=True)]


def test_fingerprints_and_edits(spark, messy, documents):
    for docs in (documents.limit(60), messy):
        docs = docs.cache()
        rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
        found = fingerprints.fingerprint_changes(docs).collect()
        assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in rows)
        marks = {t: "".join(f"{x:04x}" for x in plain_signature(t)) for _, t in rows}
        if docs is not messy and len(set(i for i, _ in rows)) == len(rows):
            rows.sort()
            by_id = {r["doc_id"]: r for r in found}
            for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
                r, n = by_id[doc_id], len(text) // 4
                edited = text[: len(text) - n] + following[:n]
                changed = plain_signature(edited)
                own = plain_signature(text)
                assert r["n_chars"] == len(text) and r["fingerprint"] == marks[text]
                assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
                assert r["edited_fingerprint"] == "".join(f"{x:04x}" for x in changed)
                assert r["near_edited"] == np.mean([a == b for a, b in zip(own, changed, strict=True)])
                assert r["near_next"] == np.mean([a == b for a, b in zip(own, plain_signature(following), strict=True)])
        else:
            assert Counter(r["fingerprint"] for r in found) == Counter(marks[t] for _, t in rows)


def test_likeness_estimates_jaccard():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(500, 1500, dtype=np.uint64)
    spread = [windows(x.copy(), 1) for x in (a, b)]
    one, two = fingerprints.slots(fingerprints.signatures(spread))
    assert abs(np.mean(one == two) - 1 / 3) < 0.2


def test_long_sets_are_cut_into_steps(monkeypatch):
    sets = [word_hashes([b"%d" % i for i in range(n)]) for n in (3, 0, 50, 7)]
    whole = fingerprints.signatures(sets)
    monkeypatch.setattr(fingerprints, "_SHINGLES_AT_ONCE", 8)
    assert (fingerprints.signatures(sets) == whole).all() and (whole[1] == fingerprints.EMPTY).all()


def test_single_row_and_no_row(spark, messy):
    one = fingerprints.fingerprint_changes(messy.filter("doc_id = 9")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprints.fingerprint_changes(messy.limit(0)).count() == 0


COUNTS = {"x": {"banana": 5, "ananas": 2, "an": 9}, "y": {"tulip": 4, "lip": 1, "an": 1}}


def test_kneser_ney_is_a_distribution():
    model = language_id.learn(COUNTS, 3)
    letters = sorted({c for own in COUNTS.values() for w in own for c in w})
    for start in ("", "b", "an", "ban", "qq", "tul"):
        total = np.zeros(2)
        before = sum_of(model, start)
        for c in letters:
            total += np.exp(sum_of(model, start + c) - before)
        end = language_id.word_scores(model, [start])[0][0] - before
        assert np.all(total + np.exp(end) <= 1 + 1e-9) and np.all(total + np.exp(end) > 0.9)


def sum_of(model, prefix):
    """Log probability of the characters of a prefix without the end of the word."""
    whole = language_id._Chars([prefix])
    result = np.zeros(2)
    hashes = [whole.hashes(n) for n in range(len(model.grams) + 1)]
    for place in range(1, len(prefix) + 1):
        factor = np.ones(2)
        for n in range(min(len(model.grams), place + 1), 0, -1):
            at, there = language_id._find(model.grams[n - 1], hashes[n][[place]])
            if there[0]:
                result += np.log(factor * model.chances[n - 1][at[0]])
                break
            at, there = language_id._find(model.contexts[n - 1], hashes[n - 1][[place - 1]])
            factor *= model.escapes[n - 1][at[0]] if there[0] else 1
        else:
            result += np.log(factor * model.floor)
    return result


def test_words_shorter_than_the_order():
    model = language_id.learn(COUNTS, 5)
    both, sizes = language_id.word_scores(model, ["a", "banana"])
    alone, size = language_id.word_scores(model, ["a"])
    assert np.allclose(both[0], alone[0]) and size[0] == sizes[0] == 2


def test_scores_do_not_depend_on_what_is_remembered(monkeypatch):
    model = language_id.learn(COUNTS, 3)
    texts = ["an lip banana", None, "tulip Ananas! 12", "", "x y z banana an"]
    whole = language_id.Scorer(model).score(texts)
    monkeypatch.setattr(language_id, "_TOKENS_AT_ONCE", 2)
    monkeypatch.setattr(language_id, "_REMEMBERED", 4)
    parts = language_id.Scorer(model).score(texts)
    assert np.allclose(whole[0], parts[0]) and (whole[1] == parts[1]).all()


def test_highest_order_counts_occurrences():
    model = language_id.learn({"x": {"ab": 3, "ac": 1}}, 2)
    chars = language_id._Chars(["ab"])
    at, there = language_id._find(model.grams[1], chars.hashes(2)[[2]])
    at_start, _ = language_id._find(model.grams[0], chars.hashes(1)[[2]])
    lower = model.chances[0][at_start[0], 0]
    counts = [4, 3, 1, 3, 1]  # of the pairs ^a, ab, ac, b$, c$: two occur once, none twice
    discount = min(counts.count(1) / max(counts.count(1) + 2 * counts.count(2), 1), 0.9)
    assert there[0] and model.chances[1][at[0], 0] == pytest.approx((3 - discount) / 4 + 2 * discount / 4 * lower)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found) and sum(r["accepted"] for r in found) > 0.99 * len(found)


def test_languages_of_messy_rows(spark, messy):
    model = language_id.fit(messy)
    rows = language_id.identify(messy, model).collect()
    assert len(rows) == messy.count()
    texts = Counter((r["doc_id"], any(c.isalpha() for c in r["text"] or "")) for r in messy.collect())
    assert Counter((r["doc_id"], r["lang_pred"] != "und") for r in rows) == texts
    assert all(r["score"] == 0 and not r["accepted"] for r in rows if r["lang_pred"] == "und")
    assert language_id.keep_accepted(messy, model).columns == messy.columns
    unknown = messy.withColumn("lang", messy.text.substr(0, 0).cast("string")).filter("lang is null")
    assert language_id.fit(unknown) is None
    assert {r["lang_pred"] for r in language_id.identify(messy, None).collect()} == {"und"}
    assert language_id.identify(messy.limit(0), model).count() == 0


def test_gibberish_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    noise = spark.createDataFrame([(1, "xqzkv wjqpx zzxqk vvqjw " * 30)], "doc_id long, text string")
    assert not language_id.identify(noise, language_id.fit(docs)).first()["accepted"]


def test_runs_of_a_fixed_count_are_learned_at_any_size(spark):
    passage = "orchids bloom quietly behind seven old harbour walls"
    base = [corpus.words(i, 1000, 300) for i in range(20)]
    gains = []
    for number in (50, 1000):  # the passage is as often there, the rest of the corpus grows
        rows = [(i, base[i % 20], None, None) for i in range(number)]
        rows += [(5000 + i, passage, None, None) for i in range(14)]
        found = suffix_tree.score(corpus.table(spark, rows)).filter("doc_id = 5000").first()
        gains.append(found["score"] - found["base_score"])
    assert min(gains) > 10 and max(gains) < 1.5 * min(gains) + 10


@pytest.mark.parametrize("sent", [0, 60])
def test_runs_looked_up_score_like_sent_ones(spark, monkeypatch, sent):
    monkeypatch.setattr(suffix_tree, "SENT", sent)
    monkeypatch.setattr(key_filter, "MOST_BITS", 1024)
    monkeypatch.setattr(suffix_tree, "_TALLIED", 500)
    monkeypatch.setattr(suffix_tree, "_BYTES_AT_ONCE", 900)
    test_tree_equals_plain_tree(spark, (8, 3), 2)


def test_sums_come_back_as_a_row_per_parcel():
    """However many texts and parts of the table there are, what is looked up leaves in as many rows as it came."""
    keys = np.arange(1, 2001, dtype=np.uint64) << np.uint64(20)
    ones, owners = np.ones(2000), np.repeat(np.arange(500, dtype=np.uint32), 4)
    sofar = np.zeros(500, suffix_tree._SOFAR_KIND)
    sofar["doc_id"], sofar["n_tokens"] = np.arange(500), 7
    for blocks in (1, 16):
        weights = list(suffix_tree._parcels(suffix_tree._WEIGHTS, 0, keys, [ones, -ones], blocks))
        group = list(suffix_tree._group_parcels(1 << 40, [sofar], [keys], [owners], blocks))
        sums = list(suffix_tree._looked_up(iter([*weights, *group[1:], group[0]])))
        assert sum(x.num_rows for x in sums) == blocks + 1
        rows = pa.Table.from_batches(sums).sort_by([("uid", "ascending"), ("kind", "descending"), ("block", "ascending")])
        found = pa.Table.from_batches(suffix_tree._added_up(iter(rows.to_batches()))).to_pylist()
        assert [r["doc_id"] for r in found] == list(range(500))
        assert all((r["n_known"], r["base_score"], r["score"]) == (4, 4, -4) for r in found)


@pytest.mark.parametrize(("tokens", "texts"), [(100, 20_000), (100, 3)])
def test_many_parts_of_the_table_score_like_one(spark, messy, monkeypatch, tokens, texts):
    monkeypatch.setattr(suffix_tree, "SENT", 0)
    rows = [(i, corpus.words(i % 40, 60, 300), None, None) for i in range(120)]
    docs = corpus.table(spark, rows).unionByName(messy.filter("length(text) < 100 OR text IS NULL"))
    want = sorted(suffix_tree.score(docs).collect(), key=str)
    monkeypatch.setattr(suffix_tree, "_TOKENS_PER_TASK", tokens)
    monkeypatch.setattr(suffix_tree, "_TEXTS_AT_ONCE", texts)
    monkeypatch.setattr(suffix_tree, "_BYTES_AT_ONCE", 900)
    found = sorted(suffix_tree.score(docs).collect(), key=str)
    assert len(found) == len(want) == docs.count()
    for a, b in zip(found, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def test_planted_context_of_six_words_becomes_a_state(spark):
    """What follows ``x b c d e f`` depends on ``x``: it takes six words to see it."""
    rows = []
    for i in range(400):
        first, last = ("left", "north") if i % 2 else ("right", "south")
        rows.append((i, f"{corpus.words(i, 8, 200)} {first} b c d e f {last} {corpus.words(-i, 8, 200)}", None, None))
    held = [i for i in range(1000, 1100) if zlib.crc32(b"%d" % i) % 7 == 2][:2]
    rows += [(i, f"left b c d e f {last}", None, None) for i, last in zip(held, ("north", "south"), strict=True)]
    docs = corpus.table(spark, rows)
    for depth, least, most in ((6, 1.5, 9), (5, -0.2, 0.2)):
        found = {r["doc_id"]: r["score"] for r in suffix_tree.score(docs, depth).filter("doc_id >= 1000").collect()}
        assert least < found[held[0]] - found[held[1]] < most
