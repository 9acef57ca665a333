"""Small tables with everything that may go wrong in them."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, length string, copy string, part long, __x int"

LONG = " ".join(f"w{i % 997} x{i % 31}" for i in range(30_000))
ROWS = [
    (5, "The quick brown fox jumps over the lazy dog, again and again.", "en", "a"),
    (5, "The quick brown fox jumps over the lazy dog, again and again.", "en", "a"),
    (5, "Same id, another text", "en", "a"),
    (None, "No id at all", "en", None),
    (None, None, None, None),
    (7, None, "en", "b"),
    (8, "", "de", "b"),
    (9, " \n\t ", None, "b"),
    (-3, "12 34 !! 56", "en", "c"),
    (2**40, "Zweimal große Straße, ‘Übung’ 12,5 % — naïve x　y", "de", "c"),
    (11, LONG, "en", "c"),
    (12, "tab\there  two  blanks\n\nand lines\r\nend ", "en", "c"),
]


def table(spark, rows=ROWS):
    full = [(*r, None if r[1] is None else len(r[1]), "clash", "clash", -1, 0) for r in rows]
    return spark.createDataFrame(full, COLUMNS)


def words(seed, number, vocabulary=50):
    draw = random.Random(seed)
    return " ".join(f"v{int(draw.random() ** 2 * vocabulary)}" for _ in range(number))
