"""Hashes of words cut out of whole texts against words one by one."""

import random

import corpus
import numpy as np

from tonewatch.llm import words


def plain(word):
    value = 0
    for i, b in enumerate(word):
        value = (value + (b + 1) * pow(words._BASE, i, 1 << 64)) % (1 << 64)
    return words.mixed(np.array([value], np.uint64))[0]


def test_words_of_texts(monkeypatch):
    draw = random.Random(1)
    texts = [bytes(draw.choice(b"aB \t\n\x0b\x0c\r\x1c\xa0\xc3z") for _ in range(draw.choice([0, 1, 5, 60]))) for _ in range(200)]
    texts += [b"", b" ", b"x" * 500, (r[1] or "").encode()[:3000] if (r := corpus.ROWS[10]) else b""]
    expected = [[plain(w) for w in t.lower().split()] for t in texts]
    for size in (1 << 20, 7, 64):
        monkeypatch.setattr(words, "_BYTES_AT_ONCE", size)
        found, numbers = words.text_words(texts)
        assert numbers.tolist() == [len(e) for e in expected]
        assert found.tolist() == [h for e in expected for h in e]
    assert words.text_words([])[0].size == 0 and words.text_words([b""])[1].tolist() == [0]


def test_hashes_of_many_words_differ():
    found, _ = words.text_words([b" ".join(b"%x" % i for i in range(200_000)), b" ".join(b"%d" % (i * 7919) for i in range(100_000))])
    plain_words = {b"%x" % i for i in range(200_000)} | {b"%d" % (i * 7919) for i in range(100_000)}
    assert len(np.unique(found)) == len(plain_words)
