"""Repairs by the automaton against plain search, and whole reports against a plain damage and repair."""

import hashlib
import random
import zlib
from collections import Counter
from functools import cache
from itertools import product

import pytest

from tonewatch.llm import conversation_repair as cr

SPACE = " \t\n\x0b\f\r"
COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def plain_repair(rows):
    """Least (cost, audit) and the roles it gives; rows are (role, fault)."""

    @cache
    def best(at, state, inserted):
        options = []
        if at == len(rows) and state in "0a":
            options.append((0, "", ()))
        turn = {"0": "u", "s": "u", "u": "a", "a": "u"}[state]
        name = {"u": "user", "a": "assistant"}[turn]
        if inserted < 3:
            cost, audit, made = best(at, turn, inserted + 1)
            options.append((cost + 5, "I" + audit, ((name, None), *made)))
        if at < len(rows):
            role, fault = rows[at]
            cost, audit, made = best(at + 1, state, 0)
            options.append((cost + 2, "D" + audit, made))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                cost, audit, made = best(at + 1, turn, 0)
                options.append((cost + 1 + more, "R" + audit, ((name, at), *made)))
                if role[:1] == turn:
                    options.append((cost + more, "K" + audit, ((role, at), *made)))
                if role[:1] == "s" and state == "0":
                    cost, audit, made = best(at + 1, "s", 0)
                    options.append((cost + more, "K" + audit, ((role, at), *made)))
        return min(options) if options else (10**9, "", ())

    return best(0, "0", 0)


def plain_damage(rows):
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        what = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if what == 1 else text.translate({ord(c): None for c in ".!?"}) if what == 2 else text
        role = "user" if what == 4 else role
        yield from [(conv, turn, role, text)] * (0 if what == 0 else 2 if what == 3 else 1)


def plain_report(rows):
    after = list(plain_damage(rows))
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in after if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:32].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, faulty = set(), []
        for _, role, text in own:
            last = text.rstrip(SPACE)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
            seen.add((role, text))
            faulty.append((role, fault))
        turns = [t for t, _, _ in own if t is not None]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(faulty, faulty[1:], strict=False)]
        cost, audit, made = plain_repair(tuple(faulty))
        lines = [f"{role}:{'' if at is None else own[at][2]}" for role, at in made]
        counts = Counter(f for _, f in faulty)
        yield (
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, counts["blank"], counts["duplicate"],
            counts["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )


def test_automaton_on_all_short_signatures():
    faults = {"x": ("u", "blank")} | {c: (c.lower(), "truncated" if c.isupper() else None) for c in "suaoSUAO"}
    words = ["".join(w) for n in range(5) for w in product("xsuaoSUAO", repeat=n)]
    automaton = cr.Automaton()
    for backwards in sorted(words):
        cost, audit, _ = plain_repair(tuple(faults[c] for c in reversed(backwards)))
        assert automaton.follow(backwards) == (cost, audit), backwards
    assert len(automaton.nodes) <= 5 and len(automaton.costs) < 400


def test_long_signatures_take_little(spark):
    automaton = cr.Automaton()
    cost, audit = automaton.follow("ua" * 200_000)
    assert (cost, len(audit)) == (min(5 + 5, 2 + 2), 400_000)
    assert automaton.nodes.itemsize + automaton.bases.itemsize <= 12


def drawn(seed, conversations):
    draw = random.Random(seed)
    texts = ["Yes.", "No", "", " \n", "Why?", "Go! ", "yes.", "a long text that goes on and on. " * 3, "end…", "\x1c.", None]
    rows = []
    for conv in range(conversations):
        for turn in range(draw.choice([1, 2, 3, 8, 15])):
            role = draw.choice(["user", "assistant"] * 5 + ["system", "tool", "", None, "sudo", "User"])
            rows.append((conv, draw.choice([turn] * 9 + [None, turn * 2]), role, draw.choice(texts)))
    return rows + [(None, None, None, None), (None, 3, "user", "Hm."), (None, 3, "user", "Hm."), (-5, 2**40, "user", "x."), (-5, -7, "system", "y.")]


@pytest.mark.parametrize("rows", [drawn(1, 60), [], [(1, i, "user", "same.") for i in range(120)]], ids=["drawn", "empty", "one"])
def test_report(spark, rows):
    table = spark.createDataFrame([(*r, 9, "x") for r in rows], "conv_id long, turn long, role string, text string, copies int, place string")
    found = cr.repair_report(cr.damage(table.repartition(5))).select(*COLUMNS)
    assert Counter(map(tuple, found.collect())) == Counter(plain_report(rows))


def test_report_of_given_conversations(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    found = cr.repair_report(cr.damage(table)).select(*COLUMNS)
    assert Counter(map(tuple, found.collect())) == Counter(plain_report(rows))


def test_repaired_rows_follow_the_grammar(spark):
    damaged = cr.damage(spark.createDataFrame(drawn(2, 40), "conv_id long, turn long, role string, text string"))
    rows = cr.repair(damaged, cr.audit(damaged)).collect()
    roles = {}
    for row in sorted(rows, key=lambda r: (r["conv_key"], r["place"])):
        roles.setdefault(row["conv_key"], []).append(row["role"][:1])
    for initials in roles.values():
        word = "".join(initials)
        word = word[1:] if word[:1] == "s" else word
        assert word == "ua" * (len(word) // 2) and word
