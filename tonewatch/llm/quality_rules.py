"""Rules on lengths, symbols, stop words and lines, as one projection of built-in expressions.

A rule is a name, a ratio and its bounds.  The table of rules is compiled into
columns of one projection; no user function is called.  The counts behind the
ratios are arrays of a text's own words and lines, so a text is settled where it
lies and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.pinning import pinned
from .common import require

#: What parts words, and the symbols that are counted.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the languages in use.
STOP_WORDS = (
    "the be to of and that have with in is for it on as was this by "
    "der die und das ist von den mit für des zu nicht "
    "le la les et des en que une du est pour dans "
    "de el los las por para con del una su al"
).split()

MIN_WORDS = 50
MOST_REPEATED_PERCENT = 50


class Rule(NamedTuple):
    name: str
    value: str
    low: float | None
    high: float | None


#: A text is kept if each value lies within its bounds, ends included; SQL that Spark and DuckDB read alike.
RULES = (
    Rule("word_count", "n_words", 50, 100_000),
    Rule("mean_word_chars", "word_chars / nullif(n_words, 0)", 2, 15),
    Rule("symbols_per_word", "n_symbols / nullif(n_words, 0)", None, 0.3),
    Rule("stop_word_share", "n_stop_words / nullif(n_words, 0)", 0.02, None),
    Rule("dup_line_share", "n_dup_lines / nullif(n_lines, 0)", None, 0.5),
    Rule("repeated_word_share", "n_repeat_words / nullif(n_words, 0)", None, 0.5),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def _stop_word(word: Column) -> Column:
    return F.lower(word).isin(STOP_WORDS)


def counts(docs: DataFrame, text_col: str = "text", kept: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``kept`` and the counts of each text; a null text has no words.

    Windows of three words are told apart by their 64-bit hash.
    """
    space = f"[{SPACE}]+"
    texts = docs.select(*kept, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    split = texts.withColumn("_words", F.array_remove(F.split("_text", space), ""))
    split = pinned(split, "_words").withColumn(
        "_windows",
        F.when(
            F.size("_words") >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size("_words") - 3),
                lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    split = pinned(split, "_windows")
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    split = split.withColumn("_placed", F.when(repeats, placed))
    split = pinned(split, "_placed")
    same = lambda x, i, step: F.coalesce(F.get("_placed", i + step)["h"] == x["h"], F.lit(False))
    twice = F.filter("_placed", lambda x, i: same(x, i, -1) | same(x, i, 1))
    split = split.withColumn("_places", F.sort_array(F.transform(twice, lambda x: x["i"])))
    split = pinned(split, "_places")
    covered = F.aggregate(
        "_places", F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")),
        lambda acc, i: F.struct(
            (acc["n"] + i + 3 - F.greatest(i, acc["end"])).alias("n"), (i + 3).alias("end")
        ),
        lambda acc: acc["n"],
    )
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    split = pinned(split.withColumn("_lines", lines), "_lines")
    symbols = F.length("_text") - F.length(F.regexp_replace("_text", f"[{SYMBOLS}]", ""))
    return split.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_words", _stop_word)).cast("long").alias("n_stop_words"),
    )


def _passes(rule: Rule) -> str:
    bounds = [f"{rule.value} >= {rule.low}"] * (rule.low is not None)
    bounds += [f"{rule.value} <= {rule.high}"] * (rule.high is not None)
    return " AND ".join(bounds)


BASE_FAILED = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words)"


def judge(counted: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``base_failed``, a column ``ok_<rule>`` per rule, and ``kept``; a ratio over nothing passes."""
    base = F.expr(BASE_FAILED)
    verdicts = {f"ok_{r.name}": F.coalesce(F.expr(_passes(r)), F.lit(True)) for r in rules}
    kept = reduce(lambda a, b: a & b, verdicts.values(), ~base)
    columns = [v.alias(k) for k, v in verdicts.items()]
    return counted.select("*", base.alias("base_failed"), *columns, kept.alias("kept"))


def quality(
    docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, the counts, the verdict of each rule, ``base_failed`` and ``kept`` of each row of ``docs``.

    Null and empty texts have no words and are not kept; rows that repeat are
    judged alike; other columns are not read.
    """
    require(docs, [id_col, text_col])
    renamed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return judge(counts(renamed), rules)


def quality_sql(rules: Sequence[Rule] = RULES) -> str:
    """DuckDB's statement of ``quality`` over ``documents``."""
    space = r"\x20\x09-\x0D"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    verdicts = {r.name: f"coalesce({_passes(r)}, true)" for r in rules}
    ok = ",\n       ".join(f"{v} AS ok_{k}" for k, v in verdicts.items())
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), parts AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^{space}]+') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) AS lines
  FROM texts
), windows AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM parts)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) AS v(d) GROUP BY r
), counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(t, '[{space}]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
         len(list_filter(words, lambda w: lower(w) IN ({stop})))::BIGINT AS n_stop_words
  FROM parts LEFT JOIN covered USING (r)
)
SELECT *, {BASE_FAILED} AS base_failed,
       {ok},
       NOT {BASE_FAILED} AND {" AND ".join(verdicts.values())} AS kept
FROM counted"""
