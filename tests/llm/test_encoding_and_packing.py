"""Ids, packing and token files against plain versions."""

import random
import struct
import sys
import zlib
from collections import Counter, defaultdict

import corpus
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tonewatch.llm import packing, token_files
from tonewatch.llm.common import arrow_map
from tonewatch.llm.encoding import Encoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def plain(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_are_those_of_the_tokenizer(path, documents):
    own, whole = Encoder(path), Tokenizer.from_file(path)
    draw = random.Random(1)
    letters = "ab1 \n\t'.!é　\xa0\x1c²́’ sΣİAZ<|"
    texts = ["".join(draw.choice(letters) for _ in range(25)) for _ in range(4000)]
    texts += [r["text"] for r in documents.limit(60).collect()] + [r[1] or "" for r in corpus.ROWS]
    texts += ["<|endoftext|> x", "a <|endoftext|> b <|startoftext|> c", "é<|endoftext|>\u0301 <|endoftext|><|endoftext|>", "<|ENDOFTEXT|>  <|endoftext|"]
    marks = ["<|endoftext|>", "<|startoftext|>", " ", "\n", "a", "'s", "É", "<|", "|>", "12"]
    texts += ["".join(draw.choice(marks) for _ in range(12)) for _ in range(2000)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text[:80]


def test_remembered_parts_are_bounded(monkeypatch):
    from tonewatch.llm import encoding

    monkeypatch.setattr(encoding, "REMEMBERED_BYTES", 20_000)
    own = Encoder(BYTES)
    assert {id(x) for x in vars(own).values() if isinstance(x, encoding._Recent)} == {id(x) for x in own.room.tables}
    for i in range(60):
        own.encode([" ".join(f"a{i}b{j}! ‘c{i}{j}’" for j in range(20))])
        held = [*own.words.items(), *own.words.older.items(), *own.literal.items(), *own.literal.older.items()]
        assert sum(sys.getsizeof(k) + sys.getsizeof(v) + encoding._ENTRY_BYTES for k, v in held) <= 20_000
    assert held


def test_only_parts_that_come_again_are_remembered(monkeypatch):
    from tonewatch.llm import encoding

    own, asked = Encoder(BYTES), Counter()
    merge = own.merge
    own.merge = lambda x: asked.update([x]) or merge(x)
    once = [f"{a}{b}{c}once" for a in "bdfgk" for b in "aeiou" for c in "lmnr"]
    text = "front " + " ".join(f"{x}, often" for x in once)
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == plain(BYTES, text)
    kept = {*own.words, *own.words.older}
    assert "often" in kept and len(kept) < 10  # words that share a mark are few
    assert asked[own.before + "often"] == 2
    own.encode([text])
    assert {f"{x}," for x in once} <= {*own.words} and once[0] not in own.words
    monkeypatch.setattr(encoding, "_SEEN", 8)
    small = Encoder(BYTES)
    for _ in range(3):  # marks run out and are begun anew
        assert small.encode([text]) == own.encode([text])
        assert len(small.room.marks) == 8 and small.room.marked <= 4


def test_ids_of_a_part_of_a_batch_are_widened():
    none = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.binary())], ["n", "ids"])
    assert not list(packing._widen("<u2")(iter([none])))
    rows = [b"", np.arange(5, dtype="<u2").tobytes(), b"", np.array([65535, 7], "<u2").tobytes()]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(rows, pa.binary())], ["n", "ids"])
    for part in (batch, batch.slice(1), batch.slice(2, 2), batch.slice(0, 1)):
        (wide,) = packing._widen("<u2")(iter([part]))
        wide.validate(full=True)
        want = [np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in part["ids"].to_pylist()]
        assert wide["ids"].to_pylist() == want and wide["n"].equals(part["n"])
        narrow = wide["ids"].to_pylist()
        assert next(packing._widen("<u4")(iter([wide])))["ids"].to_pylist() == narrow


def test_widened_ids_come_back_in_parts():
    rows = [np.full(n, i, "<u2").tobytes() for i, n in enumerate([1024] * 3000 + [0, 3, 0] + [700] * 2000 + [0])]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows, pa.binary())], ["n", "ids"])
    parts = list(packing._widen("<u2")(iter([batch, batch.slice(3000, 3)])))
    assert max(x.nbytes for x in parts) < 3 << 20  # one batch of 17 MB before
    whole = pa.Table.from_batches(parts)
    assert whole["n"].to_pylist() == [*range(len(rows)), 3000, 3001, 3002]
    assert whole["ids"].to_pylist() == [np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in rows + rows[3000:3003]]


def test_a_worker_gives_back_memory_after_each_batch(monkeypatch):
    class Pool:
        released = 0

        def release_unused(self):
            self.released += 1

    pool = Pool()
    monkeypatch.setattr(pa, "default_memory_pool", lambda: pool)

    class Table:
        class sparkSession:  # noqa: N801
            class sparkContext:  # noqa: N801
                environment: dict = {}

        def mapInArrow(self, function, schema):  # noqa: N802
            return function

    seen = [(x, pool.released) for x in arrow_map(Table(), lambda batches: iter([*batches, 7]), "n long")([5, 6])]
    assert seen == [(5, 0), (6, 1), (7, 2)] and pool.released == 4


def best_fit(lengths, capacity):
    """One piece at a time into the fullest sequence that holds it."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [i for i, room in enumerate(rooms) if room >= n]
        if fitting:
            rooms[min(fitting, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=120))
def test_plan_equals_best_fit_of_single_pieces(lengths):
    runs = packing.plan(Counter(lengths), 32)
    filled, spans = defaultdict(int), defaultdict(list)
    for n, number in Counter(lengths).items():
        for rank in range(number):
            run = [r for r in runs[n] if r.first_rank <= rank][-1]
            nth = rank - run.first_rank
            sequence = run.sequence + nth // run.per_sequence
            filled[sequence] += n
            spans[sequence].append((run.offset + nth % run.per_sequence * n, n))
    for own in spans.values():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
    assert sorted(32 - f for f in filled.values()) == best_fit(lengths, 32)


def check_packed(rows, docs):
    spans, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] * 4 == len(r["ids"]) and r["length"] <= 1024
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["piece"], bytes(r["ids"])))
    for own in spans.values():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at <= 1024
    texts = defaultdict(list)
    for d in docs:
        texts[d["doc_id"]].append(np.array([*plain(BYTES, d["text"]), 2], "<u4").tobytes())
    for doc_id, own in texts.items():
        if len(own) == 1:
            found = sorted(pieces[doc_id])
            assert [p for _, p, _ in found] == list(range(len(found)))
            assert b"".join(x for _, _, x in found) == own[0]
            assert all(len(x) == 4096 for _, _, x in found[1:])
        else:
            assert sum(len(x) for _, _, x in pieces[doc_id]) == sum(map(len, own))
    total = sum(r["length"] for r in rows)
    assert len(spans) == len(best_fit([r["length"] for r in rows], 1024)) >= -(-total // 1024)


def test_pack_messy_rows(messy, spark):
    check_packed(packing.pack(messy, BYTES).collect(), messy.collect())
    assert packing.pack(messy.limit(0), BYTES).count() == 0


def test_pack_documents(documents):
    check_packed(packing.pack(documents, BYTES).collect(), documents.collect())


def test_token_files_round_trip(messy, documents, tmp_path):
    for i, docs in enumerate((messy, documents)):
        manifest = token_files.write_token_files(docs, WORDS, 1, str(tmp_path / f"f{i}"), bytes_per_part=40_000)
        rows = token_files.read_token_files(manifest).orderBy("start").collect()
        at = 0
        for r in rows:
            assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
            at += r["n_tokens"]
        ids = [r["doc_id"] for r in rows]
        assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
        expected = Counter((d["doc_id"], np.array([*plain(WORDS, d["text"]), 1], "<u4").tobytes()) for d in docs.collect())
        assert Counter((r["doc_id"], bytes(r["ids"])) for r in rows) == expected


def test_token_file_format(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "_cuts", lambda docs, size: [])
    docs = spark.createDataFrame([(2, "b"), (1, "a"), (None, "c")], "doc_id long, text string").coalesce(1)
    (part,) = token_files.write_token_files(docs, WORDS, 1, str(tmp_path)).collect()
    ids = [x for t in "cab" for x in (*plain(WORDS, t), 1)]
    with open(part["path"] + ".bin", "rb") as f:
        assert f.read() == struct.pack("<6H", *ids)
    with open(part["path"] + ".idx", "rb") as f:
        assert f.read() == struct.pack("<9q", 3, 1, 0, 2, 4, 6, 0, 1, 2)


def test_token_files_of_nothing(messy):
    manifest = token_files.write_token_files(messy.limit(0), WORDS, 1)
    assert token_files.read_token_files(manifest).count() == 0


def test_equal_ids_fill_several_parts(spark, tmp_path):
    docs = spark.range(600).select(F.lit(4).cast("long").alias("doc_id"), F.repeat(F.lit("abc "), 50).alias("text"))
    manifest = token_files.write_token_files(docs, WORDS, 1, str(tmp_path), bytes_per_part=10_000).collect()
    assert len(manifest) > 4 and max(m["documents"] for m in manifest) < 300


def test_digests(documents, spark, sf_dir):
    from tonewatch.llm import queries

    found = {r["doc_id"]: r for r in queries.QUERIES["op4_token_files"](spark, sf_dir).collect()}
    at = 0
    for d in documents.orderBy("doc_id").collect():
        ids = np.array([*plain(WORDS, d["text"]), 1], "<u4")
        r = found[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_a_worker_keeps_one_table_of_words():
    from tonewatch.llm import common, encoding, words

    encoding.encoder(WORDS).encode(["a b c"])
    assert encoding._encoders
    words.word_hashes([b"a", b"b"])
    assert not encoding._encoders and len(words._hashes) == 2
    encoding.encoder(WORDS)
    assert not words._hashes and list(common._holders) == ["encoder"]
