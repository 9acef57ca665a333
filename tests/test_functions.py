from pyspark.sql import functions as F

from tonewatch.functions import confidence, labels

FORMS = [
    ("[Row(annotatorType='category', metadata={'0': '0.01', '1': '0.98', 'sentence': '7', '2': '2.3E-8'}, embeddings=[])]", 0.98),
    ("", 0.0),
    (None, 0.0),
    ("no meta", 0.0),
    ("metadata={'sentence': '0'}", 0.0),
    ("metadata={'0': '0.4', '1': '0.6'", 0.0),
    ("metadata={'0': '0.4' metadata={'0': '0.9'}", 0.0),
    ("metadata={'0': '0.7'} metadata={'0': '0.99'}", 0.7),
    ("metadata={'0': 0.3, '1': 0.6}", 0.6),
    ("metadata={'0': 'abc', '1': '0.5'}", 0.5),
    ('metadata={"0": "0.8"}', 0.8),
]


def test_confidence_of_printed_annotations(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FORMS)], "id int, c string")
    got = dict(map(tuple, rows.select("id", confidence.max_confidence_text(F.col("c"))).collect()))
    assert got == {i: v for i, (_, v) in enumerate(FORMS)}


def test_confidence_of_nested_annotations(spark):
    rows = spark.createDataFrame(
        [(0, [({"0": "0.2", "1": "0.7", "sentence": "9"},)]), (1, [({"sentence": "1"},)]), (2, []), (3, None), (4, [({"0": "x"},)])],
        "id int, c array<struct<metadata: map<string, string>>>",
    )
    got = dict(map(tuple, rows.select("id", confidence.max_confidence_nested(F.col("c"))).collect()))
    assert got == {0: 0.7, 1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0}


def test_label_casts_and_codes(spark):
    rows = spark.createDataFrame([("1.0",), ("2",), ("-0.7",), ("x",), ("",), (None,), ("3.0",)], "v string")
    out = rows.select(labels.cast_label(F.col("v")), labels.is_kept_class(F.col("v"))).collect()
    assert [tuple(r) for r in out] == [
        (1, True), (2, True), (0, True), (None, None), (None, None), (None, None), (3, False)
    ]
    names = spark.createDataFrame([("Neutral",), ("neutral",), (None,)], "v string")
    coded = names.select(labels.encode_label(F.col("v")).alias("c")).select("c", labels.decode_label(F.col("c")))
    assert [tuple(r) for r in coded.collect()] == [(2, "Neutral"), (None, "Unknown"), (None, "Unknown")]


def test_first_prediction_of_an_array(spark):
    rows = spark.createDataFrame([(["1", "2"],), ([],), (None,), (["x"],)], "p array<string>")
    assert [r[0] for r in rows.select(labels.unwrap_prediction(F.col("p"))).collect()] == [1.0, None, None, None]
