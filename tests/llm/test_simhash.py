"""Fingerprints, links and components against all pairs."""

import random
from collections import Counter

import corpus
import numpy as np
import pytest
import xxhash

from tonewatch.llm import simhash
from tonewatch.llm.components import components


def plain_fingerprint(text, size=4):
    shingles = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x1c", "\x00").encode().split()]
    if not shingles:
        return 0
    size = min(size, len(shingles))
    hashes = [xxhash.xxh64_intdigest(b" ".join(shingles[i : i + size]), 42) for i in range(len(shingles) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints(documents, messy):
    for docs in (documents, messy):
        texts = Counter((r["doc_id"], r["text"]) for r in docs.collect())
        expected = Counter()
        for (doc_id, text), n in texts.items():
            expected[doc_id, np.uint64(plain_fingerprint(text)).view(np.int64).item()] += n
        assert Counter(map(tuple, simhash.fingerprints(docs).collect())) == expected


def test_long_texts_are_whole(monkeypatch):
    text = corpus.words(3, 900).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_SHINGLES_AT_ONCE", 7)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text.decode())


def clustered(seed, number):
    draw = random.Random(seed)
    found = set()
    while len(found) < number:
        value = draw.getrandbits(64)
        for _ in range(draw.choice([1, 1, 5, 40])):
            found.add(value)
            for bit in draw.sample(range(64), draw.choice([0, 1, 3, 4, 5])):
                value ^= 1 << bit
    return sorted(found)


@pytest.mark.parametrize("shard_rows", [4096, 8])
@pytest.mark.parametrize("max_bits", [4, 2])
def test_links_connect_what_all_pairs_connect(spark, shard_rows, max_bits):
    values = clustered(shard_rows + max_bits, 400)
    signed = [np.uint64(v).view(np.int64).item() for v in values]
    distinct = spark.createDataFrame([(v,) for v in signed], "fingerprint long").repartition(3)
    near = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= max_bits]
    expected = plain_roots(values, near)
    found = simhash.links(distinct, max_bits, shard_rows).collect()
    own = plain_roots(signed, [tuple(r) for r in found])
    groups = {}
    for value, s in zip(values, signed, strict=True):
        groups.setdefault(own[s], set()).add(expected[value])
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len(set(expected.values()))
    assert len(found) <= 15 * len(values) * (1 if shard_rows > 400 else 64)


def test_forest_finds_all_pairs_in_small_steps(monkeypatch):
    monkeypatch.setattr(simhash, "_PAIRS_AT_ONCE", 40)
    draw = random.Random(5)
    points = np.array(sorted({draw.getrandbits(6) for _ in range(40)}), dtype=np.uint64)
    group = np.repeat([0, 1], [len(points) - 10, 10])
    forest = simhash.Forest(points, group)
    start = np.array([forest.root_of[g] for g in group.tolist()])
    found = {(a, b) for x in forest.search(points, start, 2) for a, b in zip(*map(np.ndarray.tolist, x), strict=True)}
    assert found == {
        (i, j) for i in range(len(points)) for j in range(len(points))
        if group[i] == group[j] and (int(points[i]) ^ int(points[j])).bit_count() <= 2
    }


def test_components_of_long_paths_and_stars(spark):
    draw = random.Random(2)
    path = list(range(0, 200))
    draw.shuffle(path)
    pairs = list(zip(path, path[1:])) + [(500, x) for x in range(501, 700)] + [(9000, 9000), (8001, 8000), (8000, 8001)]
    found = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    expected = plain_roots({x for p in pairs for x in p}, pairs)
    assert found == {n: r for n, r in expected.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_components(rows):
    marks = [plain_fingerprint(r["text"]) for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 4]
    root = plain_roots(range(len(rows)), near)
    least = {}
    for i, r in enumerate(rows):
        ids = [x for x in (least.get(root[i]), r["doc_id"]) if x is not None]
        least[root[i]] = min(ids, default=None)
    return marks, root, least


def test_near_duplicates_and_keep_one(documents, messy):
    for docs in (documents, messy):
        rows = docs.collect()
        marks, root, least = plain_components(rows)
        expected = Counter((r["doc_id"], f"{m:016x}", least[root[i]]) for i, (r, m) in enumerate(zip(rows, marks, strict=True)))
        found = simhash.near_duplicates(docs)
        found = found.select("doc_id", simhash.hex_digits(found["fingerprint"]), "component_id").collect()
        assert Counter(map(tuple, found)) == expected
        kept = simhash.keep_one(docs)
        assert kept.columns == docs.columns
        assert Counter(r["doc_id"] for r in kept.collect()) == Counter(least[x] for x in set(root.values()))


def test_nothing(messy):
    assert simhash.near_duplicates(messy.limit(0)).count() == simhash.keep_one(messy.limit(0)).count() == 0
