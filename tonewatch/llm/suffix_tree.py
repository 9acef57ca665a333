"""A probabilistic suffix tree over words, learned from a corpus, that scores whole texts.

Symbols are words, and one end per text.  A context of up to ``DEPTH`` words is
a candidate if it occurs at least ``CONTEXT_COUNT`` times in the training texts.
It becomes a state if what follows it diverges from what follows the context
without its first word, and so do the states on its way to the root.  A state
keeps the symbols that follow it at least ``NEXT_COUNT`` times, discounted; the
mass this leaves goes to the next shorter state.  The root is the add-one
distribution of all words of the corpus.  A token is scored by the state of the
longest suffix of what precedes it.

These counts do not depend on the size of the corpus, so contexts and
transitions grow with it.  They are Spark tables by the hash of their words.
The log probability of a text is a sum over its runs of words: a run adds the
log of what it leaves to shorter states, and how much likelier its last word is
than by the state before.  So one table of weights by run scores all texts.
The most frequent runs, a bounded number, are sent to the tasks; each text's
other runs are sent in sorted blocks to where their part of the table is held,
and come back as sums, a row for each group of texts and part of the table,
which are added up where the group is.

Words, and runs of words, are told apart by their 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize
from .common import Batches, arrow_map, partitions_for, require
from .key_filter import KeyFilter, key_filter
from .words import text_words

DEPTH = 2
CONTEXT_COUNT = 8
NEXT_COUNT = 3
#: Least divergence, in nats, that makes a context a state.
DIVERGENCE = 0.02
DISCOUNT = 0.75

#: The end of a text; no word holds white space.
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))
#: So many of the most frequent runs, at most, are sent to all tasks.
SENT = 1_500_000
#: Weights of rarer runs that a task holds, and tokens whose rarer runs come to it.
_RARE_PER_TASK, _TOKENS_PER_TASK = 1_000_000, 3_000_000
#: Rarer runs, or weights, that a task sends at once: as many to each block, within bounds.
_KEYS_PER_PARCEL, _KEYS_AT_ONCE, _MOST_KEYS_AT_ONCE = 2_000, 150_000, 1_000_000
_TEXTS_AT_ONCE = 20_000
_BYTES_AT_ONCE = 1 << 20
_TALLIED = 400_000
#: Texts of this many bytes are counted by one task after the shuffle, from so many blocks of each sender.
_BYTES_PER_COUNTER = 8 << 20
_BLOCKS = 4


class Tree(NamedTuple):
    """What is learned: ``weights(key, n, base, score)`` of words and runs, over the weight of an unseen word."""

    depth: int
    tokens: int
    words: int
    weights: DataFrame

    @property
    def unseen(self) -> float:
        return -float(np.log10(self.tokens + self.words + 1))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a row without id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _slices(batches: Batches, columns: Sequence[str]) -> Iterator[tuple[list, list[bytes]]]:
    """Rows and their texts, a bounded number of bytes at a time."""
    rows, texts, size = [], [], 0
    for batch in batches:
        for *row, text in zip(*(batch[c] for c in [*columns, "text"]), strict=True):
            rows.append([x.as_py() for x in row])
            texts.append(text.as_py() or b"")
            size += len(texts[-1]) + 1
            if size >= _BYTES_AT_ONCE:
                yield rows, texts
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def _symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the symbols of all texts, each followed by the end; their places in their texts; the texts' sizes."""
    words, sizes = text_words(texts)
    sizes = sizes + 1
    ends = np.cumsum(sizes)
    hashes = np.full(int(ends[-1]) if len(ends) else 0, END)
    inside = np.ones(len(hashes), bool)
    inside[ends - 1] = False
    hashes[inside] = words
    return hashes, np.arange(len(hashes)) - np.repeat(ends - sizes, sizes), sizes


def _longer(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Keys of runs by those of all but their last symbol."""
    return (context << np.uint64(1) | context >> np.uint64(63)) ^ symbol


def _longer_sql(context: Column, symbol: Column) -> Column:
    turned = F.shiftleft(context, 1).bitwiseOR(F.shiftrightunsigned(context, 63))
    return turned.bitwiseXOR(symbol)


def _runs(hashes: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each length the key of the run that ends at each symbol; only those within a text mean something."""
    found = [hashes]
    for _ in range(longest - 1):
        found.append(_longer(np.concatenate([found[-1][:1], found[-1][:-1]]), hashes))
    return found


class _Tally:
    """Counts of 64-bit keys in bounded memory; what no longer fits leaves as rows."""

    def __init__(self) -> None:
        self.keys, self.counts, self.waiting = np.empty(0, np.int64), np.empty(0, np.int64), []

    def add(self, keys: np.ndarray) -> None:
        found, times = np.unique(keys, return_counts=True)
        self.waiting.append((found, times))
        if sum(len(k) for k, _ in self.waiting) > _TALLIED // 4:
            self._settle()

    def _settle(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self.waiting]])
        self.keys, of = np.unique(keys, return_inverse=True)
        self.counts, self.waiting = np.bincount(of, counts, len(self.keys)).astype(np.int64), []

    def rows(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        """All rows, if there are more than ``least``."""
        if len(self.keys) > least or not least:
            self._settle()
            yield pa.RecordBatch.from_arrays([pa.array(self.keys), pa.array(self.counts)], ["key", "n"])
            self.keys, self.counts = self.keys[:0], self.counts[:0]


def _word_counts(docs: DataFrame) -> DataFrame:
    """``(key, n)`` of the symbols of all rows, counted in the tasks first."""
    def run(batches: Batches) -> Batches:
        tally = _Tally()
        for _, texts in _slices(batches, []):
            tally.add(_symbols(texts)[0].view(np.int64))
            yield from tally.rows(_TALLIED)
        yield from tally.rows()

    return arrow_map(docs.select("text"), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class _Pairs:
    """Counts of (context, symbol), by the key of both together."""

    def __init__(self) -> None:
        self.held = [np.empty(0, np.uint64)] * 3 + [np.empty(0, np.int64)]
        self.waiting: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, context: np.ndarray, symbol: np.ndarray, n: np.ndarray | None = None) -> None:
        key = _longer(context, symbol)
        if n is None:
            key, at, n = np.unique(key, return_index=True, return_counts=True)
            context, symbol = context[at], symbol[at]
        self.waiting.append([key, context, symbol, n])
        self.size += len(key)
        if self.size > _TALLIED // 2:
            self.settle()

    def settle(self) -> None:
        key, context, symbol, n = (np.concatenate(x) for x in zip(self.held, *self.waiting, strict=True))
        key, at, of = np.unique(key, return_index=True, return_inverse=True)
        self.held = [key, context[at], symbol[at], np.bincount(of, n, len(key)).astype(np.int64)]
        self.waiting, self.size = [], 0


_BLOCK = "block int, context binary, symbol binary, n binary"
_PAIR = "key long, context long, symbol long, n long"


def _pairs(docs: DataFrame, length: int, contexts, shorter, counters: int, least: float) -> DataFrame:
    """``_PAIR`` of what follows runs of ``length`` words that pass ``contexts``, at least ``least`` times.

    A run is no more frequent than the same without its first word, so only runs
    whose shorter one passes ``shorter``, which holds those as frequent as
    that, are sent.  Tasks send blocks of sorted pairs instead of rows, dealt by
    the hash of the pair.
    """
    blocks = counters * _BLOCKS

    def sent(tally: _Pairs) -> Iterator[pa.RecordBatch]:
        tally.settle()
        key, context, symbol, n = tally.held
        block = (key >> np.uint64(20)) % np.uint64(blocks)
        order = np.lexsort((context, block))
        block, context, symbol, n = block[order], context[order], symbol[order], n[order].astype(np.uint32)
        cuts = np.flatnonzero(np.diff(block)) + 1
        starts, ends = [0, *cuts.tolist()], [*cuts.tolist(), len(block)]
        if len(block):
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[starts].astype(np.int32))]
                + [pa.array([x[i:j].tobytes() for i, j in zip(starts, ends, strict=True)]) for x in (context, symbol, n)],
                ["block", "context", "symbol", "n"],
            )

    def send(batches: Batches) -> Batches:
        passing, short, tally = contexts.value, shorter.value, _Pairs()
        for _, texts in _slices(batches, []):
            hashes, place, _ = _symbols(texts)
            runs = _runs(hashes, length)[-1]
            at = np.flatnonzero(place >= length)
            at = at[short.passes(runs[at])]
            at = at[passing.passes(runs[at - 1])]
            tally.add(runs[at - 1], hashes[at])
            if len(tally.held[0]) > _TALLIED:
                yield from sent(tally)
                tally = _Pairs()
        yield from sent(tally)

    def count(batches: Batches) -> Batches:
        tally = _Pairs()
        for batch in batches:
            for context, symbol, n in zip(batch["context"], batch["symbol"], batch["n"], strict=True):
                tally.add(
                    np.frombuffer(context.as_py(), np.uint64), np.frombuffer(symbol.as_py(), np.uint64),
                    np.frombuffer(n.as_py(), np.uint32).astype(np.int64),
                )
        tally.settle()
        enough = tally.held[3] >= least
        key, context, symbol, n = (x[enough].view(np.int64) for x in tally.held)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, context, symbol, n)], ["key", "context", "symbol", "n"])

    dealt = arrow_map(docs.select("text"), send, _BLOCK).repartition(counters, "block")
    return arrow_map(dealt, count, _PAIR)


def learn(
    docs: DataFrame, depth: int = DEPTH, divergence: float = DIVERGENCE,
    context_count: int = CONTEXT_COUNT, next_count: int = NEXT_COUNT,
) -> Tree:
    """The tree of ``docs(text)``; levels end with ``depth``, or earlier where no run is frequent enough.

    One pass over the texts counts words, and one each level's transitions; a
    level's tables are deleted when what follows from them is written.
    """
    spark = docs.sparkSession
    words = materialize(_word_counts(docs), "word_counts")
    tokens, number = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    counters = partitions_for(spark, size, _BYTES_PER_COUNTER)
    least = min(next_count, context_count)
    # Runs of one more word at each level, with their chance and the run without its first word.
    below = words.select("key", "n", ((F.col("n") + 1) / F.lit(float(tokens + number + 1))).alias("chance"))
    below = below.withColumn("shorter", F.lit(None).cast("long"))
    levels: list[tuple[DataFrame, DataFrame]] = []
    for length in range(1, depth + 1):
        contexts = below.filter(F.col("n") >= context_count).select(
            F.col("key").alias("context"), F.col("n").alias("total"), F.col("shorter").alias("up")
        )
        if contexts.isEmpty():
            break
        passing = spark.sparkContext.broadcast(key_filter(contexts.select(F.col("context").alias("key"))))
        frequent = spark.sparkContext.broadcast(key_filter(below.filter(F.col("n") >= least).select("key")))
        pairs = _pairs(docs, length, passing, frequent, counters, least).join(contexts, "context")
        shorter = F.col("symbol") if length == 1 else _longer_sql(F.col("up"), F.col("symbol"))
        shorts = below.filter(F.col("n") >= least).select(F.col("key").alias("shorter"), F.col("chance").alias("below"))
        runs = materialize(pairs.withColumn("shorter", shorter).drop("symbol").join(shorts, "shorter"), "runs")
        p = F.col("n") / F.col("total")
        sums = runs.filter(F.col("n") >= next_count).groupBy("context").agg(
            F.any_value("up").alias("up"), F.any_value("total").alias("total"),
            F.sum((F.col("n") - DISCOUNT) / F.col("total")).alias("taken"),
            F.sum(p * F.log(p / F.col("below"))).alias("gain"), F.sum(p).alias("p"), F.sum("below").alias("q"),
        )
        left, left_below = F.greatest(1 - F.col("p"), F.lit(0.0)), F.greatest(1 - F.col("q"), F.lit(1e-12))
        gain = F.col("gain") + F.when(left > 0, left * F.log(left / left_below)).otherwise(0.0)
        states = materialize(
            sums.select("context", "up", "total", (1 - F.col("taken")).alias("rest"), gain.alias("gain")), "states"
        )
        share = F.when(F.col("n") >= next_count, (F.col("n") - DISCOUNT) / F.col("total")).otherwise(0.0)
        chance = share + F.coalesce("rest", F.lit(1.0)) * F.col("below")
        level = runs.join(states.select("context", "rest"), "context", "left").withColumn("chance", chance)
        below = materialize(level.select("context", "key", "n", "shorter", "below", "rest", "chance"), "level")
        discard(runs)
        levels.append((below, states))
        passing.destroy()
        frequent.destroy()
    tree = Tree(len(levels), tokens, number, _weights(words, levels, divergence, next_count))
    for used in (words, *[x for level in levels for x in level]):
        discard(used)
    return tree


def _weights(words: DataFrame, levels: list[tuple[DataFrame, DataFrame]], divergence: float, least: float) -> DataFrame:
    """``(key, n, base, score)`` of every word and of the runs that the states add something to.

    A state's shorter contexts are states as well, so its chances are those of
    the test, in which all candidates were.
    """
    known = F.log10(F.col("n") + 1)
    parts = [words.select("key", "n", known.alias("base"), known.alias("score"))]
    longer = None
    for runs, states in reversed(levels):
        kept = F.col("gain") >= divergence
        if longer is not None:
            on_way = longer.select(F.col("up").alias("context")).distinct().withColumn("on_way", F.lit(True))
            states = states.join(on_way, "context", "left")
            kept = kept | F.coalesce("on_way", F.lit(False))
        states = longer = materialize(states.filter(kept).select("context", "up", "total", "rest"), "kept_states")
        none = F.lit(0.0)
        parts.append(states.select(F.col("context").alias("key"), F.col("total").alias("n"), none, F.log10("rest")))
        gain = F.log10(F.col("chance") / F.col("rest") / F.col("below"))
        own = runs.filter(F.col("n") >= least).join(states.select("context"), "context", "left_semi")
        parts.append(own.select("key", "n", none, gain))
    both = parts[0]
    for part in parts[1:]:
        both = both.union(part)
    return materialize(
        both.groupBy("key").agg(F.max("n").alias("n"), F.sum("base").alias("base"), F.sum("score").alias("score")), "weights"
    )


def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key, -1 where it is not."""
    if not len(sorted_keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == wanted, at, -1)


class _Sent(NamedTuple):
    """What every scoring task gets: weights of frequent runs, sorted by key, and a filter of all."""

    longest: int
    unseen: float
    keys: np.ndarray
    base: np.ndarray
    score: np.ndarray
    all: KeyFilter


def _sent_from(weights: DataFrame) -> int:
    """The least count, a power of two, from which at most ``SENT`` runs on are sent."""
    power = F.floor(F.log2("n")).cast("int")
    sizes = weights.groupBy(power.alias("power")).agg(F.count("*").alias("n")).collect()  # at most 64 rows
    least, number = 62, 0
    for found, size in sorted(sizes, reverse=True):
        number += size
        if number > SENT:
            break
        least = found
    return 1 << least


def _sent(tree: Tree, least: int) -> _Sent:
    found = tree.weights.filter(F.col("n") >= least).drop("n").toArrow()
    keys = found["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    base, score = (found[c].to_numpy()[order] for c in ("base", "score"))
    return _Sent(tree.depth + 1, tree.unseen, keys[order], base, score, key_filter(tree.weights.select("key")))


#: Rows on their way to where rarer runs are looked up: weights, runs of texts, and what the texts have so far.
_WEIGHTS, _RUNS, _SOFAR = range(3)
_PARCEL = "block int, kind int, uid long, one binary, two binary, three binary"
_SUMS = "uid long, kind int, block int, sums binary"
_SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"
_SOFAR_KIND = np.dtype([("doc_id", "<i8"), ("no_id", "?"), ("n_tokens", "<i8"), ("known", "<i8"), ("base", "<f8"), ("score", "<f8")])
_SUM_KIND = np.dtype([("text", "<u4"), ("known", "<u4"), ("base", "<f8"), ("score", "<f8")])


def _at_once(blocks: int) -> int:
    """Keys that a task sorts and sends at once: more for more blocks, so that rows stay long."""
    return min(max(_KEYS_AT_ONCE, blocks * _KEYS_PER_PARCEL), _MOST_KEYS_AT_ONCE)


def _parcels(kind: int, uid: int, keys: np.ndarray, others: Sequence[np.ndarray], blocks: int) -> Iterator[pa.RecordBatch]:
    """Rows of sorted keys, a row per block."""
    block = (keys >> np.uint64(20)) % np.uint64(blocks)
    order = np.lexsort((keys, block))
    block, columns = block[order], [x[order] for x in (keys, *others)]
    cuts = np.flatnonzero(np.diff(block)) + 1
    starts, ends = [0, *cuts.tolist()], [*cuts.tolist(), len(block)]
    if len(block):
        parts = [pa.array([x[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()) for x in columns]
        number = len(starts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(block[starts].astype(np.int32)), pa.array([kind] * number, pa.int32()), pa.array([uid] * number, pa.int64()), *parts],
            [x.split()[0] for x in _PARCEL.split(", ")],
        )


def _weight_parcels(blocks: int):
    def run(batches: Batches) -> Batches:
        waiting, size = [], 0
        for batch in batches:
            waiting.append((batch["key"].to_numpy().view(np.uint64), batch["base"].to_numpy(), batch["score"].to_numpy()))
            size += batch.num_rows
            if size >= _at_once(blocks):
                key, *others = (np.concatenate(x) for x in zip(*waiting, strict=True))
                waiting, size = [], 0
                yield from _parcels(_WEIGHTS, 0, key, others, blocks)
        if waiting:
            key, *others = (np.concatenate(x) for x in zip(*waiting, strict=True))
            yield from _parcels(_WEIGHTS, 0, key, others, blocks)

    return run


def _scored_parcels(shared, blocks: int):
    """What texts have by the frequent runs, and their other runs that the filter lets pass.

    Texts leave in groups, told apart by the number of their first.
    """

    def run(batches: Batches) -> Batches:
        sent = shared.value
        part = TaskContext.get().partitionId()
        first = uid = part << 40
        done, keys, owners, waiting = [], [], [], 0
        for rows, texts in _slices(batches, ["doc_id"]):
            hashes, place, sizes = _symbols(texts)
            number = len(texts)
            text = np.repeat(np.arange(number), sizes)
            sofar = np.zeros(number, _SOFAR_KIND)
            sofar["doc_id"] = [r[0] or 0 for r in rows]
            sofar["no_id"] = [r[0] is None for r in rows]
            sofar["n_tokens"], sofar["base"] = sizes, sizes * sent.unseen
            sofar["score"] = sofar["base"]
            for n, key in enumerate(_runs(hashes, sent.longest)):
                at = np.flatnonzero(place >= n)
                at = at[sent.all.passes(key[at])]
                found = _find(sent.keys, key[at])
                hit = found >= 0
                own, found = text[at[hit]], found[hit]
                sofar["base"] += np.bincount(own, sent.base[found], number)
                sofar["score"] += np.bincount(own, sent.score[found], number)
                sofar["known"] += np.bincount(own, sent.base[found] > 0, number).astype(np.int64)
                keys.append(key[at[~hit]])
                owners.append((text[at[~hit]] + (uid - first)).astype(np.uint32))
                waiting += len(keys[-1])
            done.append(sofar)
            uid += number
            if waiting >= _at_once(blocks) or uid - first >= _TEXTS_AT_ONCE:
                yield from _group_parcels(first, done, keys, owners, blocks)
                first, done, keys, owners, waiting = uid, [], [], [], 0
        if done:
            yield from _group_parcels(first, done, keys, owners, blocks)

    return run


def _group_parcels(
    first: int, done: list[np.ndarray], keys: list[np.ndarray], owners: list[np.ndarray], blocks: int
) -> Iterator[pa.RecordBatch]:
    """What a group of texts has so far, and its runs with their texts, each text's repeats of a run as one."""
    nothing = [pa.array([None], pa.binary())] * 2
    yield pa.RecordBatch.from_arrays(
        [pa.array([(first + (first >> 40)) % blocks], pa.int32()), pa.array([_SOFAR], pa.int32()), pa.array([first]),
         pa.array([np.concatenate(done).tobytes()]), *nothing],
        [x.split()[0] for x in _PARCEL.split(", ")],
    )
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(new)
    times = np.diff(np.append(starts, len(key))).astype(np.uint32)
    yield from _parcels(_RUNS, first, key[starts], [owner[starts], times], blocks)


def _looked_up(batches: Batches) -> Batches:
    """``_SUMS``: what each parcel of runs adds to the texts of its group, as one row.  Weights come first."""
    names = [x.split()[0] for x in _SUMS.split(", ")]
    held: list[tuple] = []
    table = None
    for batch in batches:
        rows = []
        places = zip(*(batch[c].to_pylist() for c in ("uid", "kind", "block")), strict=True)
        for at, (uid, kind, block) in enumerate(places):
            def values(column: str, of, batch: pa.RecordBatch = batch, at: int = at) -> np.ndarray:
                return np.frombuffer(batch[column][at].as_buffer(), of)

            if kind == _WEIGHTS:
                held.append((values("one", np.uint64).copy(), values("two", np.float64).copy(), values("three", np.float64).copy()))
                continue
            if kind == _SOFAR:
                rows.append((uid, kind, block, batch["one"][at].as_py()))
                continue
            if table is None:
                empty = (np.empty(0, np.uint64), np.empty(0), np.empty(0))
                table = [np.concatenate(x) for x in zip(empty, *held, strict=True)]
                order = np.argsort(table[0])
                table, held = [x[order] for x in table], []
            found = _find(table[0], values("one", np.uint64))
            hit = found >= 0
            own, times = (values(c, np.uint32)[hit] for c in ("two", "three"))
            if not len(own):
                continue
            base, score = table[1][found[hit]], table[2][found[hit]]
            texts, of = np.unique(own, return_inverse=True)
            sums = np.empty(len(texts), _SUM_KIND)
            sums["text"], sums["known"] = texts, np.bincount(of, (base > 0) * times)
            sums["base"], sums["score"] = np.bincount(of, base * times), np.bincount(of, score * times)
            rows.append((uid, kind, block, sums.tobytes()))
        if rows:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _added_up(batches: Batches) -> Batches:
    """``_SCORED``: a row per text, from the sums of its group, which come one after the other."""
    names = [x.split()[0] for x in _SCORED.split(", ")]

    def scored(parts: list[np.ndarray]) -> pa.RecordBatch:
        whole = np.concatenate(parts)
        ids = pa.array(whole["doc_id"].copy(), mask=whole["no_id"].copy())
        return pa.RecordBatch.from_arrays([ids, *(pa.array(whole[c].copy()) for c in ("n_tokens", "known", "base", "score"))], names)

    group, done, size = None, [], 0
    for batch in batches:
        for at, (uid, kind) in enumerate(zip(batch["uid"].to_pylist(), batch["kind"].to_pylist(), strict=True)):
            values = batch["sums"][at].as_buffer()
            if kind == _SOFAR:
                if size >= _TEXTS_AT_ONCE:
                    yield scored(done)
                    done, size = [], 0
                group, whole = uid, np.frombuffer(values, _SOFAR_KIND).copy()
                done.append(whole)
                size += len(whole)
                continue
            if uid != group:
                raise ValueError(f"sums of texts from {uid} on without the texts")
            sums = np.frombuffer(values, _SUM_KIND)
            for column in ("known", "base", "score"):  # a text comes once in a row of sums
                whole[column][sums["text"]] += sums[column]
    if done:
        yield scored(done)


def score(
    docs: DataFrame, depth: int = DEPTH, divergence: float = DIVERGENCE, id_col: str = "doc_id", text_col: str = "text",
    context_count: int = CONTEXT_COUNT, next_count: int = NEXT_COUNT,
) -> DataFrame:
    """Learn from the rows that are not held out and score all rows.

    Columns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score``; scores are log10 probabilities, ``base_score`` that of the root
    alone.  Null and empty texts are one end; repeated rows count as often as
    they are there; with nothing to learn from every token has probability 1;
    an empty table gives no rows.  Other columns of ``docs`` are not read.
    """
    require(docs, [id_col, text_col])
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    tree = learn(texts.filter(~held_out(F.col("doc_id"))), depth, divergence, context_count, next_count)
    least = _sent_from(tree.weights)
    shared = spark.sparkContext.broadcast(_sent(tree, least))
    rare = tree.weights.filter(F.col("n") < least)
    blocks = max(partitions_for(spark, rare.count(), _RARE_PER_TASK), -(-tree.tokens // _TOKENS_PER_TASK))
    parcels = arrow_map(rare.select("key", "base", "score"), _weight_parcels(blocks), _PARCEL)
    parcels = parcels.unionByName(arrow_map(texts, _scored_parcels(shared, blocks), _PARCEL))
    sums = arrow_map(parcels.repartition(blocks, "block").sortWithinPartitions("kind"), _looked_up, _SUMS)
    # The texts of a group come before what is added to them, always in the same order.
    sums = sums.repartition(blocks, "uid").sortWithinPartitions("uid", F.desc("kind"), "block")
    return arrow_map(sums, _added_up, _SCORED).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(tree.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
