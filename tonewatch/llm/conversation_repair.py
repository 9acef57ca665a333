"""Cheapest repair of conversations, by an automaton that shares the ends of their signatures.

A conversation's signature has a letter per row: the role's initial and whether
the row may stay.  Signatures read from their ends and sorted let those with the
same end follow each other.  A task walks them as paths of a suffix-shared
automaton: what two signatures end with is one chain of nodes, the cost-to-go
and the first edit of the best repair are settled once per node and grammar
state, and nodes with the same differences of costs and the same edits are one.
First edits from a node and a state differ in their letter, so the least letter
of the cheapest ones spells the least audit of all cheapest repairs.

Rows are sorted by ranges, not gathered by conversation: a range gives the
piece of each signature that lies in it.  A node beyond the path in hand is
dropped, so a task holds one path, ten bytes a row of its longest conversation.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import Batches, arrow_map, partitions_for, require

#: White space, what ends a sentence, costs of edits, and the damage done by remainder.
SPACE = " \t\n\x0b\f\r"
ENDS = ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
DROP, EMPTY, CUT, REPEAT, TURN_USER, DAMAGES = 0, 1, 2, 3, 4, 20
LEGAL = ("su", "ua", "au")

#: Kinds of rows by their text.
_BLANK, _CUT, _WHOLE = 0, 1, 2
#: Grammar states: nothing yet, after the system's turn, after the user's, after the assistant's.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: Where a user's or assistant's turn leads, and whose turn it is.
_AFTER = (_USER, _USER, _ASSISTANT, _USER)
_TURN = ("user", "user", "assistant", "user")
_STOP = ""

_ROWS_PER_TASK = 500_000
_BYTES_PER_TASK = 64 << 20
#: Code points of a text that order rows of the same turn and role; then its digest does.
_HEAD = 32


def _or_space(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)``: each row damaged by ``crc32("conv_id:turn") % 20``.

    0 drops the row (``copies`` 0), 1 empties its text, 2 removes ``.!?`` from
    it, 3 repeats it (``copies`` 2), 4 makes it the user's.  Nulls are one space
    in role, text and key; the columns ``conv_id`` and ``turn`` keep their nulls.
    """
    require(conversations, ["conv_id", "turn", "role", "text"])
    key = F.concat(_or_space(F.col("conv_id")), F.lit(":"), _or_space(F.col("turn")))
    what = F.crc32(key.cast("binary")) % DAMAGES
    text, role = _or_space(F.col("text")), _or_space(F.col("role"))
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(what == TURN_USER, "user").otherwise(role).alias("role"),
        F.when(what == EMPTY, "").when(what == CUT, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        F.when(what == DROP, 0).when(what == REPEAT, 2).otherwise(1).alias("copies"),
    )


def _rows(conversations: DataFrame) -> DataFrame:
    """Rows with their place's columns: ``conv_key, turn, role, head, digest``."""
    text, role = _or_space(F.col("text")), _or_space(F.col("role"))
    return conversations.select(
        _or_space(F.col("conv_id")).alias("conv_key"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.substring(text, 1, _HEAD).alias("head"), F.md5(text.cast("binary")).alias("digest"), text.alias("text"),
        F.col("copies").cast("long").alias("copies"),
    )


_PLACE = ["conv_key", "turn", "role", "head", "digest"]
_PIECE = (
    "conv_key string, range int, letters string, n_blank long, n_duplicate long, n_truncated long, n_illegal long, "
    "first string, last string, low long, high long, n_turns long"
)


def _pieces(batches: Batches) -> Batches:
    """Per conversation of a sorted range its letters and counts."""
    kinds = [pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 4, *[pa.string()] * 2, *[pa.int64()] * 3]
    names = [x.split()[0] for x in _PIECE.split(", ")]
    part = TaskContext.get().partitionId()

    def sent(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    found: list[tuple] = []
    now = letters = None
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("conv_key", "turn", "role", "kind", "copies", "first")]
        for key, turn, role, kind, copies, first in zip(*columns, strict=True):
            if key != now:
                if now is not None:
                    found.append((now, part, "".join(letters), *counts, begin, last, low, high, turns))
                now, letters, counts = key, [], [0, 0, 0, 0]
                begin = last = low = high = None
                turns = 0
            if not copies:
                continue
            initial = role[:1]
            if begin is None:
                begin = initial
            else:
                counts[3] += last + initial not in LEGAL
            counts[3] += (copies - 1) * (2 * initial not in LEGAL)
            last = initial
            if turn is not None and turn != high:
                low, high, turns = turn if low is None else low, turn, turns + 1
            letter = initial if initial and initial in "sua" else "o"
            if kind == _BLANK:
                counts[0] += copies
                letters.append("x" * copies)
                continue
            again = copies - 1 if first else copies
            counts[1] += again
            if first:
                counts[2] += kind == _CUT
                letters.append(letter.upper() if kind == _CUT else letter)
            letters.append("x" * again)
        if len(found) > 1000:
            yield sent(found)
            found = []
    if now is not None:
        found.append((now, part, "".join(letters), *counts, begin, last, low, high, turns))
    if found:
        yield sent(found)


class Automaton:
    """Nodes of one path from the end of a signature, and classes of nodes that cost alike."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.costs: list[tuple[int, ...]] = []
        self.edits: list[tuple[str, ...]] = []
        self.steps: dict[tuple[int, str], tuple[int, int]] = {}
        self.path = ""
        end, _ = self._node((0, 2 * INSERT, INSERT, 0), (_STOP, "I", "I", _STOP))
        self.nodes, self.bases = array("i", [end]), array("q", [0])

    def _node(self, costs: tuple[int, ...], edits: tuple[str, ...]) -> tuple[int, int]:
        """Class of a node and what it costs more than the class says."""
        base = min(costs)
        key = (tuple(c - base for c in costs), edits)
        if key not in self.known:
            self.known[key] = len(self.costs)
            self.costs.append(key[0])
            self.edits.append(edits)
        return self.known[key], base

    def _step(self, node: int, letter: str) -> tuple[int, int]:
        """The node before ``node`` on a row of this letter; settled once per class."""
        if (node, letter) in self.steps:
            return self.steps[node, letter]
        after, row = self.costs[node], letter.lower()
        best = []
        for state in range(4):
            options = [(DELETE + after[state], "D")]
            if row != "x":
                more = TRUNCATED if letter.isupper() else 0
                options.append((REROLE + more + after[_AFTER[state]], "R"))
                if row == _TURN[state][0]:
                    options.append((more + after[_AFTER[state]], "K"))
                elif row == "s" and state == _START:
                    options.append((more + after[_SYSTEM], "K"))
            best.append(min(options))
        # An insertion stays at its row; two in a row lead back, so one suffices after a turn of either.
        user = min(best[_USER], (INSERT + best[_ASSISTANT][0], "I"))
        assistant = min(best[_ASSISTANT], (INSERT + best[_USER][0], "I"))
        start, system = (min(best[s], (INSERT + user[0], "I")) for s in (_START, _SYSTEM))
        costs, edits = zip(start, system, user, assistant, strict=True)
        found = self.steps[node, letter] = self._node(costs, edits)
        return found

    def follow(self, backwards: str) -> tuple[int, str]:
        """Cost and audit of the signature whose letters from the end are ``backwards``."""
        shared = len(commonprefix([self.path, backwards]))
        del self.nodes[shared + 1 :], self.bases[shared + 1 :]
        for letter in backwards[shared:]:
            node, base = self._step(self.nodes[-1], letter)
            self.nodes.append(node)
            self.bases.append(self.bases[-1] + base)
        self.path = backwards
        at, state, audit = len(backwards), _START, []
        cost = self.bases[at] + self.costs[self.nodes[at]][_START]
        while edit := self.edits[self.nodes[at]][state]:
            audit.append(edit)
            if edit != "I":
                at -= 1
            if edit == "K" and backwards[at] in "sS":
                state = _SYSTEM
            elif edit != "D":
                state = _AFTER[state]
        return cost, "".join(audit)


_AUDIT = (
    "conv_key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
)


def _audits(batches: Batches) -> Batches:
    automaton = Automaton()
    kinds, names = [pa.string(), *[pa.int64()] * 6, pa.string()], [x.split()[0] for x in _AUDIT.split(", ")]
    last, answer = None, None
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            if row["backwards"] != last:
                last, answer = row["backwards"], automaton.follow(row["backwards"])
            blank = duplicate = truncated = illegal = turns = 0
            before = low = high = None
            for piece in row["pieces"]:
                blank, duplicate = blank + piece["n_blank"], duplicate + piece["n_duplicate"]
                truncated, illegal = truncated + piece["n_truncated"], illegal + piece["n_illegal"]
                if piece["first"] is not None:
                    illegal += before is not None and before + piece["first"] not in LEGAL
                    before = piece["last"]
                if piece["n_turns"]:
                    turns += piece["n_turns"] - (piece["low"] == high)
                    low, high = piece["low"] if low is None else low, piece["high"]
            gaps = high - low + 1 - turns if turns else 0
            found.append((row["conv_key"], gaps, blank, duplicate, truncated, illegal, *answer))
        if found:
            columns = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def audit(conversations: DataFrame) -> DataFrame:
    """``_AUDIT`` of each conversation: its faults and the cheapest edits that make it legal.

    ``conversations(conv_id, turn, role, text, copies)``; ``copies`` equal rows
    follow each other, and 0 says that the row is gone while its conversation
    stays.  Rows go by turn, nulls first; then by role, the text's first 32 code
    points and its md5.  Nulls in the other columns are one space.  A row's first
    fault counts: blank, duplicate (role and text earlier in the conversation),
    truncated.  Rows without fault may be kept (cost 0) or given to the user or
    assistant (1), truncated ones at 5 more; any row may be deleted (2), blank
    and duplicate ones must; an empty turn of the user or assistant costs 5.
    Initials of roles then read ``(s?(ua)+)?``.  The audit has the edits'
    initials, the ASCII-least of the cheapest.  Other columns are not read; an
    empty table gives no rows.
    """
    require(conversations, ["conv_id", "turn", "role", "text", "copies"])
    spark = conversations.sparkSession
    rows = _rows(conversations)
    stripped = F.rtrim("text", F.lit(SPACE))
    kind = F.when(F.length(stripped) == 0, _BLANK).when(F.substring(stripped, -1, 1).isin(*ENDS), _WHOLE).otherwise(_CUT)
    # Equal rows are one from here on, and texts stay where they are.
    turns = rows.withColumn("kind", kind).groupBy(*_PLACE, "kind").agg(F.sum("copies").alias("copies"))
    turns = materialize(turns.withColumn("turn_key", _or_space(F.col("turn"))), "turns")
    least = F.when(F.bool_or(F.col("turn").isNull()), F.lit(" ")).otherwise(F.min("turn").cast("string"))
    firsts = turns.filter("copies > 0").groupBy("conv_key", "role", "digest").agg(least.alias("turn_key"))
    on = ["conv_key", "role", "digest", "turn_key"]
    turns = turns.join(firsts.withColumn("first", F.lit(True)), on, "left")
    turns = materialize(turns.withColumn("first", F.coalesce("first", F.lit(False))).drop("turn_key"), "first_turns")
    ranges = partitions_for(spark, turns.count(), _ROWS_PER_TASK)
    dealt = turns.repartitionByRange(ranges, *_PLACE).sortWithinPartitions(*_PLACE)
    pieces = arrow_map(dealt.select("conv_key", "turn", "role", "kind", "copies", "first"), _pieces, _PIECE)
    names = [x.split()[0] for x in _PIECE.split(", ")][1:]
    whole = pieces.groupBy("conv_key").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("pieces"))
    backwards = F.reverse(F.array_join(F.transform("pieces", lambda x: x["letters"]), ""))
    whole = materialize(whole.withColumn("backwards", backwards), "signatures")
    ranges = partitions_for(spark, whole.count(), _ROWS_PER_TASK)
    order = ["backwards", "conv_key"]
    return arrow_map(whole.repartitionByRange(ranges, *order).sortWithinPartitions(*order), _audits, _AUDIT)


_REPAIRED = "conv_key string, place long, edit string, role string, text string"


def _repaired(batches: Batches) -> Batches:
    names, kinds = [x.split()[0] for x in _REPAIRED.split(", ")], [pa.string(), pa.int64(), *[pa.string()] * 3]
    key, edits, at, state, place = None, "", 0, _START, 0

    def inserted() -> Iterator[tuple]:
        nonlocal at, state, place
        while at < len(edits) and edits[at] == "I":
            yield key, place, "I", _TURN[state], ""
            at, state, place = at + 1, _AFTER[state], place + 1

    for batch in batches:
        found = []
        for row in batch.to_pylist():
            if row["audit"] is not None:  # the first row of each conversation
                found += inserted()
                key, edits, at, state, place = row["conv_key"], row["audit"], 0, _START, 0
                continue
            for _ in range(row["copies"]):
                found += inserted()
                edit, at = edits[at], at + 1
                if edit == "D":
                    continue
                role = row["role"] if edit == "K" else _TURN[state]
                found.append((key, place, edit, role, row["text"]))
                state = _SYSTEM if edit == "K" and role.startswith("s") else _AFTER[state]
                place += 1
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)
    if found := list(inserted()):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)


def repair(conversations: DataFrame, audits: DataFrame) -> DataFrame:
    """``(conv_key, place, edit, role, text)`` of the rows that the edits of ``audits`` leave and insert.

    A conversation's rows lie in one partition in ascending ``place``, so a
    digest over them needs no other shuffle; a task streams them and holds one
    audit.  Conversations of which nothing is left have no row.
    """
    spark = conversations.sparkSession
    rows = _rows(conversations).filter("copies > 0")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    none = F.lit(None)
    heads = audits.select("conv_key", "audit")
    both = rows.withColumn("audit", none.cast("string")).unionByName(heads, allowMissingColumns=True)
    both = both.withColumn("is_row", F.col("audit").isNull())
    dealt = both.repartition(partitions_for(spark, size, _BYTES_PER_TASK), "conv_key")
    dealt = dealt.sortWithinPartitions("conv_key", "is_row", *_PLACE[1:])
    return arrow_map(dealt.select("conv_key", "audit", "role", "text", "copies"), _repaired, _REPAIRED)


def _digests(batches: Batches) -> Batches:
    key, digest = None, None
    for batch in batches:
        found = []
        for own, role, text in zip(*(batch[c].to_pylist() for c in ("conv_key", "role", "text")), strict=True):
            line = f"{role}:{text}".encode()
            if own == key:
                digest.update(b"\n" + line)
                continue
            if key is not None:
                found.append((key, digest.hexdigest()))
            key, digest = own, hashlib.sha256(line)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["conv_key", "repaired_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["conv_key", "repaired_sha256"])


def repair_report(conversations: DataFrame) -> DataFrame:
    """Faults, cost and audit of each conversation, and the SHA-256 of its repaired lines ``role:text``.

    Input and order of rows are those of ``audit``; a conversation of which
    nothing is left has the digest of the empty string.
    """
    kind = conversations.schema["conv_id"].dataType
    audits = materialize(audit(conversations), "audits")
    digests = arrow_map(repair(conversations, audits), _digests, "conv_key string, repaired_sha256 string")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    conv_id = F.when(F.col("conv_key") != " ", F.col("conv_key")).cast(kind).alias("conv_id")
    names = [x.split()[0] for x in _AUDIT.split(", ")][1:]
    return audits.join(digests, "conv_key", "left").select(
        conv_id, *names, F.coalesce("repaired_sha256", empty).alias("repaired_sha256")
    )
