"""Language identification by interpolated Kneser-Ney models of the characters of words.

A model per language is learned from a bounded sample of documents with a known
language.  A word is a run of letters between two boundary marks; an n-gram of
up to ``ORDER`` characters never reaches over a boundary.  All languages share
one sorted array of n-gram hashes per order, with a column of interpolated
probabilities per language, so one search serves all of them.  The language with
the lowest cross-entropy per character wins; a text whose cross-entropy is far
above what its language's own texts show is rejected.

Since a word's probability does not depend on its neighbours, a worker scores a
word once and remembers it, up to a bound.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Batches, arrow_map, hold, require

ORDER = 5
#: Documents per language that the models are learned from, and that score and rejection are calibrated on.
FITTED, CALIBRATED = 300, 150
#: A text is rejected if its cross-entropy is so many deviations above the mean of its language, and so far on the
#: way from that mean to characters at random.
DEVIATIONS, TOWARDS_RANDOM = 6.0, 0.6
UNKNOWN = "und"

_REMEMBERED = 200_000
#: Texts are taken together up to so many tokens.
_TOKENS_AT_ONCE = 1 << 16
_MULTIPLIER = 0xD6E8FEB86659FD93
_START, _END = "\x02", "\x03"
_SHARPNESS = (0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0)

RESULT = "doc_id long, lang_pred string, score double, cross_entropy double, accepted boolean"


def words_of(token: str) -> list[str]:
    """Runs of letters in a token, in lower case."""
    token = token.lower()
    if token.isalpha():
        return [token]
    return "".join(c if c.isalpha() else " " for c in token).split()


class _Grams(NamedTuple):
    """All n-grams of one order in a list of words: where they end, their hash, that of all but the last character."""

    place: np.ndarray
    gram: np.ndarray
    context: np.ndarray
    at_start: np.ndarray  # the n-gram begins with the boundary mark


class _Chars:
    """Characters of words between boundary marks, one after the other."""

    def __init__(self, words: Sequence[str]) -> None:
        text = "".join(f"{_START}{w}{_END}" for w in words)
        self.codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        self.word = np.repeat(np.arange(len(words)), lengths)
        self.inside = np.arange(len(self.codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.lengths = lengths

    def hashes(self, order: int) -> np.ndarray:
        """At each place the hash of the ``order`` characters that end there; 0 for none."""
        total, power = np.zeros(len(self.codes), np.uint64), 1
        for back in range(min(order, len(self.codes))):
            total[back:] += (self.codes[: len(self.codes) - back] + np.uint64(1)) * np.uint64(power)
            power = power * _MULTIPLIER % (1 << 64)
        return total

    def grams(self, order: int) -> _Grams:
        place = np.flatnonzero((self.inside >= order - 1) & (self.inside >= 1))
        context = self.hashes(order - 1)
        return _Grams(
            place, self.hashes(order)[place], context[place - 1], self.inside[place] == order - 1
        )


class Model(NamedTuple):
    languages: list[str]
    grams: list[np.ndarray]  # by order from 1: sorted hashes
    chances: list[np.ndarray]  # a row per n-gram, a column per language: its probability after its context
    contexts: list[np.ndarray]  # by order from 1: sorted hashes of the contexts
    escapes: list[np.ndarray]  # what of a context's probability goes to shorter ones
    floor: float
    mean: np.ndarray  # cross-entropy of a language's own texts
    deviation: np.ndarray
    sharpness: float


def _find(sorted_values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted value, and whether it is there."""
    if not len(sorted_values):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return at, sorted_values[at] == wanted


def learn(counts: dict[str, dict[str, int]], order: int = ORDER) -> Model:
    """Kneser-Ney models from how often each language's sample has each word.

    The highest order counts occurrences; a lower one counts the characters
    seen before an n-gram, but occurrences where it begins a word.
    """
    languages = sorted(counts)
    size = len(languages)
    chars = {x: _Chars(list(counts[x])) for x in languages}
    times = {x: np.fromiter(counts[x].values(), np.float64, len(counts[x])) for x in languages}
    letters = {c for x in languages for w in counts[x] for c in w}
    floor = 1.0 / (len(letters) + 2)
    adjusted: list[dict[str, tuple]] = []
    for n in range(1, order + 1):
        found = {}
        for x in languages:
            own = chars[x].grams(n)
            gram, first, of = np.unique(own.gram, return_index=True, return_inverse=True)
            weight = times[x][chars[x].word[own.place]]
            occurs = np.bincount(of, weight, len(gram))
            if n < order:
                longer = chars[x].grams(n + 1)
                _, one = np.unique(longer.gram, return_index=True)
                tail = chars[x].hashes(n)[longer.place[one]]
                at, there = _find(gram, tail)
                before = np.bincount(at[there], minlength=len(gram))
                occurs = np.where(own.at_start[first], occurs, before)
            found[x] = (gram, own.context[first], occurs)
        adjusted.append(found)
    grams, chances, contexts, escapes = [], [], [], []
    model = Model(languages, grams, chances, contexts, escapes, floor, np.zeros(size), np.ones(size), 1.0)
    for n, found in enumerate(adjusted, 1):
        all_grams, one = np.unique(np.concatenate([found[x][0] for x in languages]), return_index=True)
        of_context = np.concatenate([found[x][1] for x in languages])[one]
        all_contexts = np.unique(of_context)
        lower = np.full((len(all_grams), size), floor)
        if n > 1:  # the probability of the same character after the context without its first one
            tails, short = _tails(chars, n, languages)
            at, _ = _find(tails, all_grams)
            lower = _lookup(model, n - 1, short[0][at], short[1][at])
        chance, escape = np.array(lower), np.ones((len(all_contexts), size))
        for k, x in enumerate(languages):
            gram, context, occurs = found[x]
            ones, twos = (occurs == 1).sum(), (occurs == 2).sum()
            discount = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.9)
            at_context, _ = _find(all_contexts, context)
            total = np.bincount(at_context, occurs, len(all_contexts))
            kinds = np.bincount(at_context, minlength=len(all_contexts))
            seen = total > 0
            escape[seen, k] = discount * kinds[seen] / total[seen]
            own = np.zeros(len(all_grams))
            own[_find(all_grams, gram)[0]] = np.maximum(occurs - discount, 0)
            at_context, _ = _find(all_contexts, of_context)
            share = own / np.maximum(total[at_context], 1)
            chance[:, k] = share + escape[at_context, k] * lower[:, k]
        grams.append(all_grams)
        chances.append(chance)
        contexts.append(all_contexts)
        escapes.append(escape)
    return model


def _tails(chars: dict[str, _Chars], n: int, languages: Sequence[str]):
    """N-grams of order ``n``, sorted, with the hashes of the same without their first character and of its context."""
    parts = []
    for x in languages:
        own = chars[x].grams(n)
        shorter = chars[x].hashes(n - 1)[own.place]
        context = chars[x].hashes(n - 2)[own.place - 1] if n > 2 else np.zeros(len(own.place), np.uint64)
        parts.append((own.gram, shorter, context))
    gram, shorter, context = (np.concatenate([p[i] for p in parts]) for i in range(3))
    tails, one = np.unique(gram, return_index=True)
    return tails, (shorter[one], context[one])


def _lookup(model: Model, n: int, gram: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Probabilities of n-grams that all are in the tables of order ``n``, or else the escape to the floor."""
    at, there = _find(model.grams[n - 1], gram)
    found = model.chances[n - 1][at]
    if not there.all():
        found[~there] = model.floor
    return found


def word_scores(model: Model, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each word in each language, and its characters with the mark at the end."""
    chars = _Chars(words)
    total = np.zeros((len(words), len(model.languages)))
    order = len(model.grams)
    place = np.flatnonzero(chars.inside >= 1)
    hashes = [chars.hashes(n) for n in range(order + 1)]
    factor = np.ones((len(place), len(model.languages)))
    result = np.zeros_like(factor)
    waiting = np.arange(len(place))
    for n in range(order, 0, -1):
        now = waiting[chars.inside[place[waiting]] >= n - 1]
        at, there = _find(model.grams[n - 1], hashes[n][place[now]])
        hit = now[there]
        result[hit] = factor[hit] * model.chances[n - 1][at[there]]
        miss = now[~there]
        at, known = _find(model.contexts[n - 1], hashes[n - 1][place[miss] - 1])
        factor[miss[known]] *= model.escapes[n - 1][at[known]]
        settled = np.zeros(len(place), bool)
        settled[hit] = True
        waiting = waiting[~settled[waiting]]
    result[waiting] = factor[waiting] * model.floor
    np.add.at(total, chars.word[place], np.log(result))
    return total, chars.lengths - 1


class Scorer:
    """Sums of log probabilities over whole texts, with the tokens met lately remembered."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sums = np.zeros((1 << 12, len(self.model.languages)))
        self.sizes = np.zeros(1 << 12, np.int64)

    def _learn(self, tokens: Sequence[str]) -> None:
        parts = [words_of(t) for t in tokens]
        owner = np.repeat(np.arange(len(tokens)), [len(p) for p in parts])
        words = [w for p in parts for w in p]
        sums, sizes = np.zeros((len(tokens), self.sums.shape[1])), np.zeros(len(tokens), np.int64)
        if words:
            found, length = word_scores(self.model, words)
            np.add.at(sums, owner, found)
            np.add.at(sizes, owner, length)
        first = len(self.known)
        while first + len(tokens) > len(self.sizes):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.sums[first : first + len(tokens)] = sums
        self.sizes[first : first + len(tokens)] = sizes
        self.known.update(zip(tokens, range(first, first + len(tokens)), strict=True))

    def score(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities per language and characters of each text; no letters, no characters."""
        total = np.zeros((len(texts), len(self.model.languages)))
        size = np.zeros(len(texts), np.int64)
        tokens: list[str] = []
        owners: list[tuple[int, int]] = []
        for i, text in enumerate(texts):
            own = text.split() if text else []
            tokens += own
            owners.append((i, len(own)))
            if len(tokens) >= _TOKENS_AT_ONCE or i + 1 == len(texts):
                self._add(tokens, owners, total, size)
                tokens, owners = [], []
        return total, size

    def _add(self, tokens: list[str], owners: list[tuple[int, int]], total: np.ndarray, size: np.ndarray) -> None:
        """Add the tokens of some texts, ``(text, number)`` in a row, to the sums."""
        new = set(tokens).difference(self.known)
        if new:
            if len(self.known) + len(new) > _REMEMBERED:
                self._forget()
                new = set(tokens)
            self._learn(sorted(new))
        at = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        text = np.repeat([i for i, _ in owners], [n for _, n in owners])
        for k in range(total.shape[1]):
            total[:, k] += np.bincount(text, self.sums[at, k], len(total))
        size += np.bincount(text, self.sizes[at], len(size)).astype(np.int64)


def _posterior(total: np.ndarray, size: np.ndarray, sharpness: float) -> np.ndarray:
    """Probabilities of the languages from log probabilities, softened by the root of the length."""
    scaled = sharpness * total / np.sqrt(np.maximum(size, 1))[:, None]
    scaled -= scaled.max(axis=1, keepdims=True)
    return np.exp(scaled) / np.exp(scaled).sum(axis=1, keepdims=True)


def calibrate(model: Model, texts: Sequence[str], languages: Sequence[str]) -> Model:
    """Fit the sharpness of the score, and each language's usual cross-entropy, on texts not learned from."""
    total, size = Scorer(model).score(texts)
    own = np.array([model.languages.index(x) for x in languages], dtype=np.int64)
    use = size > 0
    if not use.any():
        return model
    total, size, own = total[use], size[use], own[use]
    rows = np.arange(len(own))
    loss = [-np.log(np.maximum(_posterior(total, size, s)[rows, own], 1e-12)).mean() for s in _SHARPNESS]
    entropy = -total[rows, own] / size
    mean, deviation = np.array(model.mean), np.array(model.deviation)
    for k in range(len(model.languages)):
        values, lengths = entropy[own == k], size[own == k]
        if len(values):
            mean[k] = np.average(values, weights=lengths)
            deviation[k] = max(np.sqrt(np.average((values - mean[k]) ** 2, weights=lengths)), 0.05)
    return model._replace(mean=mean, deviation=deviation, sharpness=_SHARPNESS[int(np.argmin(loss))])


def training_rows(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang") -> Column:
    """Rows that may be learned from: a known language, and crc32 of the id modulo 4 is not 2."""
    return F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a row without id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(
    docs: DataFrame, fitted: int = FITTED, calibrated: int = CALIBRATED, id_col: str = "doc_id",
    text_col: str = "text", lang_col: str = "lang",
) -> Model | None:
    """Learn from at most ``fitted + calibrated`` documents per language: those with the least hashes of their id.

    An id that repeats is one document, with the least of its texts.  The words of the sample are counted by Spark; what reaches the driver is
    bounded by the sample.  None if no row has a known language.
    """
    require(docs, [id_col, text_col, lang_col])
    known = docs.filter(training_rows(docs, id_col, lang_col) & F.col(text_col).isNotNull())
    keyed = known.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"))
    keyed = keyed.withColumn("_hash", F.xxhash64("_id"))
    # A language may have a third of all rows: only the share with the least hashes, some times the sample, is
    # ranked.  The numbers of different ids, a row per language and a few percent off at most, go to the rows, so that
    # the others leave before anything is dealt; an id that repeats counts once.
    rows = keyed.groupBy(F.col("_lang").alias("_of")).agg(F.approx_count_distinct("_id", 0.02).alias("_rows"))
    share = (F.col("_hash") / F.lit(2.0**64) + 0.5) * F.col("_rows")
    few = keyed.join(F.broadcast(rows), F.col("_lang") == F.col("_of")).filter(share < 4.0 * (fitted + calibrated) + 100)
    few = few.select("_id", "_lang", "_hash").distinct()
    order = Window.partitionBy("_lang").orderBy("_hash", "_id")
    ranked = few.select("_id", "_lang", F.row_number().over(order).alias("_n"))
    sample = ranked.filter(F.col("_n") <= fitted + calibrated).collect()
    if not sample:
        return None
    chosen = {x["_id"] for x in sample}
    last = {x["_id"] for x in sample if x["_n"] > fitted}
    texts = known.filter(F.col(id_col).isin(list(chosen))).select(
        F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text")
    )
    # One text per id and language, the least: the sample is bounded by texts, however often ids repeat.
    texts = texts.groupBy("_id", "_lang").agg(F.min("_text").alias("_text"))

    def count(batches: Batches) -> Batches:
        for batch in batches:
            found: dict[tuple[str, str], int] = {}
            for doc_id, lang, text in zip(*(batch[c].to_pylist() for c in ("_id", "_lang", "_text")), strict=True):
                if doc_id not in last:
                    for token in text.split():
                        for word in words_of(token):
                            found[lang, word] = found.get((lang, word), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()),
                 pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"],
            )

    words = arrow_map(texts, count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for row in words.orderBy("lang", "word").toArrow().to_pylist():
        counts.setdefault(row["lang"], {})[row["word"]] = row["n"]
    if not counts:
        return None
    model = learn(counts)
    rest = texts.filter(F.col("_id").isin(list(last) or [None])).select("_text", "_lang").collect()
    rest = [x for x in rest if x["_lang"] in counts]
    return calibrate(model, [x["_text"] for x in rest], [x["_lang"] for x in rest])


_scorers: dict[int, Scorer] = {}


def _judge(model: Model | None, ids: pa.Array, texts: Sequence[str | None]) -> list[pa.Array]:
    number = len(texts)
    if model is None:
        return [ids, pa.array([UNKNOWN] * number), pa.array([0.0] * number),
                pa.array([None] * number, pa.float64()), pa.array([False] * number)]
    hold("language", _scorers.clear)
    if id(model) not in _scorers:
        _scorers.clear()
        _scorers[id(model)] = Scorer(model)
    total, size = _scorers[id(model)].score(texts)
    entropy = -total / np.maximum(size, 1)[:, None]
    best = entropy.argmin(axis=1)
    rows = np.arange(number)
    empty = size == 0
    lowest = entropy[rows, best]
    score = np.where(empty, 0.0, _posterior(total, size, model.sharpness)[rows, best])
    spread = np.maximum(
        model.deviation[best] * DEVIATIONS * (1 + 8 / np.sqrt(np.maximum(size, 1))),
        TOWARDS_RANDOM * (-np.log(model.floor) - model.mean[best]),
    )
    accepted = ~empty & (lowest <= model.mean[best] + spread)
    names = [UNKNOWN if e else model.languages[b] for e, b in zip(empty, best, strict=True)]
    return [ids, pa.array(names), pa.array(score), pa.array(lowest, mask=empty), pa.array(accepted)]


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of each row: columns ``RESULT``.

    Null texts, and texts without a letter, are ``und`` with score 0 and are not
    accepted; equal entropies go to the first language by name; without a model
    every text is ``und``.  Other columns of ``docs`` are not read.
    """
    require(docs, [id_col, text_col])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample of ``fit``

    def run(batches: Batches) -> Batches:
        for batch in batches:
            columns = _judge(shared.value, batch["doc_id"], batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in RESULT.split(", ")])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(texts, run, RESULT)


def keep_accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with all their columns.

    Null texts, and texts without a letter, go; without a model all rows do.
    Repeated rows stay as often as they are there; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            nothing = pa.nulls(batch.num_rows, pa.int64())
            yield batch.filter(_judge(shared.value, nothing, batch[text_col].to_pylist())[-1])

    return arrow_map(docs, run, docs.schema)
