"""Cleaning against an independent row-by-row reading of the nine steps."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonewatch.constants import ENGLISH_STOP_WORDS
from tonewatch.functions import text
from tonewatch.functions.text import whitespace_tokens
from tonewatch.operators.annotate import annotate_tokens
from tonewatch.operators.cleaning import clean_text_column, drop_header_row, preprocess

SPACE = "[\t\n\x0b\f\r ]"
NON_SPACE = "[^\t\n\x0b\f\r ]"

EIGHT_STEPS = [
    ("Hi🙂 http://a.b/c🙂d e", "hi e"),
    ("@Bob #Tag9 don't <UNK> <unk> 12", " dont unk "),
    ("İK ÀB", "ik b"),
    ("a\x0bb\tc\xa0d", "a b cd"),
    ("x.com/y site.comfort", "x site"),
    ("#été fin", "t fin"),
    ("中文 abc 한글", " abc "),
    ("ht🙂tp://joined.example/x the end", " the end"),
    ("", ""),
    (" the  ", " the "),
    (None, None),
]


def plainly(value, steps=9):
    """The chain, one step after the other, without any shortcut."""
    if value is None:
        return None
    value = re.sub("[\u200d\u231a\u23cf\u23e9\u24c2-\U0010ffff]+", "", value)
    value = re.sub(f"https?://{NON_SPACE}+|www\\.{NON_SPACE}+|\\.com{NON_SPACE}+|youtu\\.be/{NON_SPACE}+", "", value)
    value = re.sub(r"(@|#)[a-zA-Z0-9_]+", "", value)
    value = value.replace("<unk>", "").lower()
    value = re.sub("[0-9]+", "", value)
    value = re.sub("[^a-zA-Z\t\n\x0b\f\r ]", "", value)
    value = re.sub(SPACE + "+", " ", value)
    if steps == 8:
        return value
    if value == "":
        return None
    return " ".join(w for w in value.split() if w not in set(ENGLISH_STOP_WORDS))


def chain(df):
    for step in (text.strip_emoji, text.strip_urls, text.strip_mentions, text.strip_unknown_token, text.normalize_alpha):
        df = df.withColumn("Text", step(F.col("Text")))
    return df


def test_first_eight_steps(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(EIGHT_STEPS)], "id int, Text string")
    got = {r["id"]: r["Text"] for r in chain(rows).collect()}
    for i, (raw, expected) in enumerate(EIGHT_STEPS):
        assert got[i] == expected == plainly(raw, 8)


def test_whole_chain_and_blank_contract(spark):
    raws = [t for t, _ in EIGHT_STEPS] + ["the and of", "123 !!", "Good movie"]
    rows = spark.createDataFrame(list(enumerate(raws)), "id int, Text string")
    got = {r["id"]: r["Text"] for r in clean_text_column(rows).collect()}
    assert [got[i] for i in range(len(raws))] == [plainly(t) for t in raws]
    assert got[raws.index("the and of")] == ""
    assert got[raws.index("")] is None


PIECES = st.sampled_from(
    ["the", "Don't", " ", "  ", "\t", "\n", "🙂", "http", "://x", "www.", "a.com", "/z", "youtu.be/", "@me", "#", "9", "<unk>", "é", "Z", "!", "中", "x"]
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=1, max_size=60))
def test_any_text_matches_and_cleaning_twice_changes_nothing(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, Text string")
    once = clean_text_column(rows)
    twice = clean_text_column(once, output_col="Again")
    for r in twice.join(rows.withColumnRenamed("Text", "raw"), "id").collect():
        assert r["Text"] == plainly(r["raw"])
        if r["Text"]:
            assert "\n" in r["Text"] or r["Again"] == plainly(r["Text"])


def test_light_variant_keeps_stop_words_and_unknown_token_letters(spark):
    rows = spark.createDataFrame([("The <unk> 12 @me end!",)], "Text string")
    assert rows.select(text.clean_text_light(F.col("Text"))).first()[0] == "the unk end"


def test_preprocess_drops_what_it_should(spark):
    raw = spark.createDataFrame(
        [("p", "Positive", "Great stuff"), ("p", "Other", "Great stuff"), ("p", "", "Great"), ("p", "Neutral", None),
         ("p", "Neutral", "   "), ("p", "Negative", "the of"), ("p", "Negative", "123"), ("p", "Irrelevant", "Some thing")],
        "_c0 string, _c1 string, _c2 string",
    )
    rows = preprocess(raw)
    assert rows.dtypes == [("Label", "int"), ("Text", "string")]
    assert sorted(map(tuple, rows.collect())) == [(1, "great stuff"), (3, "thing")]


def test_header_row_goes_and_no_other(spark):
    raw = spark.createDataFrame(
        [("Product", "Label", "Text"), ("a", "Label", "Text"), (None, None, None)], "Product string, Label string, Text string"
    )
    assert sorted(map(str, drop_header_row(raw).collect())) == sorted(
        ["Row(Product='a', Label='Label', Text='Text')", "Row(Product=None, Label=None, Text=None)"]
    )


@pytest.mark.parametrize("value", ["  Hello,  the\tWORLD's end ", "x", "", "   ", "a  b"])
def test_annotations_point_into_the_text(spark, value):
    tokens = annotate_tokens(spark.createDataFrame([(value,)], "Text string")).first()["tokens"]
    spans = [(m.start(), m.end() - 1, re.sub(r"[^\w+]|\d|_", "", m.group().lower())) for m in re.finditer(r"\S+", value)]
    assert [tuple(t) for t in tokens] == [s for s in spans if s[2] and s[2] not in ENGLISH_STOP_WORDS]


def test_whitespace_tokens_has_no_empty_words(spark):
    rows = spark.createDataFrame([("  a\t b\n",), ("",), ("  ",)], "t string")
    assert [r[0] for r in rows.select(whitespace_tokens(F.col("t"))).collect()] == [["a", "b"], [], []]


# The ranges of code points that count as emoji, each as its first and last.
EMOJI_RANGES = (
    (0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF), (0x1F1E0, 0x1F1FF), (0x2500, 0x2BEF),
    (0x2702, 0x27B0), (0x24C2, 0x1F251), (0x1F926, 0x1F937), (0x10000, 0x10FFFF), (0x2640, 0x2642),
    (0x2600, 0x2B55), (0x200D, 0x200D), (0x23CF, 0x23CF), (0x23E9, 0x23E9), (0x231A, 0x231A),
    (0xFE0F, 0xFE0F), (0x3030, 0x3030),
)


def test_emoji_class_over_all_code_points(spark):
    points = spark.range(1, 0x110000).filter("id < 55296 OR id > 57343")
    high, low = F.lit(0xD800) + F.floor((F.col("id") - 0x10000) / 1024), F.lit(0xDC00) + (F.col("id") - 0x10000) % 1024
    units = F.when(F.col("id") < 0x10000, F.col("id")).otherwise(high * 65536 + low)
    width = F.when(F.col("id") < 0x10000, 4).otherwise(8)
    char = F.decode(F.unhex(F.lpad(F.hex(units.cast("long")), width, F.lit("0"))), "UTF-16BE")
    stripped = text.strip_emoji(F.concat(F.lit("a"), char, F.lit("b"))) == "ab"  # nothing else may go
    inside = F.lit(False)
    for first, last in EMOJI_RANGES:
        inside = inside | F.col("id").between(first, last)
    wrong = points.filter(stripped != inside)
    assert wrong.count() == 0
