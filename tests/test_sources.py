import json

import pytest
from pyspark.sql import functions as F

from tonewatch.operators import registry
from tonewatch.schemas import RAW_COMMENTS
from tonewatch.session import materialize, scratch_path, shared_dir
from tonewatch.sources import csv_tables, objects, writers


def test_csv_keeps_quotes_commas_breaks_and_spaces(spark):
    rows = [("p", "Neutral", 'say "hi", ok'), ("p", "Neutral", "two\nlines"), ("p", "Neutral", "  pad  "), ("p", None, "x"),
            ("", "", ""), (None, None, None), ("p", "", None), ("", None, "\\N")]
    path = scratch_path(spark, "csv")
    csv_tables.write_csv(spark.createDataFrame(rows, RAW_COMMENTS), path)
    back = csv_tables.read_csv(spark, path, multi_line=True)
    assert back.schema == RAW_COMMENTS
    assert sorted(map(str, back.collect())) == sorted(str(r) for r in spark.createDataFrame(rows, RAW_COMMENTS).collect())


def test_csv_written_by_pandas_is_read_right(spark, tmp_path):
    import pandas as pd

    frame = pd.DataFrame({"Product": ["a", "b", "c"], "Label": ["x", "y", "z"], "Text": ['q "w", e', "l1\nl2", "plain"]})
    frame.to_csv(tmp_path / "t.csv", index=False)
    assert [r["Text"] for r in csv_tables.read_csv(spark, str(tmp_path / "t.csv"), multi_line=True).collect()] == list(frame["Text"])


def test_empty_text_and_null_survive_csv_without_a_header(spark):
    rows = {("", "a"), (None, "b"), ("x", ""), ("y", None)}
    path = scratch_path(spark, "csv")
    csv_tables.write_csv(spark.createDataFrame(list(rows), "Label string, Text string"), path, header=False)
    assert set(map(tuple, csv_tables.read_csv_headerless(spark, path, ["Label", "Text"]).collect())) == rows


def test_malformed_records_can_be_counted(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Product,Label,Text\na,b,c\na,b\na,b,c,d\n")
    rows = csv_tables.read_csv(spark, str(tmp_path / "t.csv"), malformed_col="bad").cache()
    assert rows.count() == 3 and rows.filter("bad IS NOT NULL").count() == 2


def test_csv_files_are_bounded_by_bytes(spark, tmp_path):
    rows = spark.range(1000).select(F.repeat(F.lit("x"), 100).alias("Text")).coalesce(1)
    csv_tables.write_csv(rows, str(tmp_path / "out"), bytes_per_file=20_000)
    assert 4 <= len(list((tmp_path / "out").glob("*.csv"))) <= 8


def test_dataset_write_returns_its_row_count(spark):
    path = scratch_path(spark, "dataset")
    assert writers.write_dataset(spark.range(123), path) == 123
    assert spark.read.parquet(path).count() == 123


def test_alert_log_keeps_each_run_once(spark):
    path = scratch_path(spark, "alerts")
    alerts = spark.range(2).select(F.lit("t").alias("timestamp"), F.struct(F.lit("é").alias("name")).alias("details"))
    for run in ("a", "b", "a"):
        writers.append_alert_log(alerts, path, run)
    lines = [json.loads(r["value"]) for r in spark.read.text(path).collect()]
    assert lines == [{"timestamp": "t", "details": {"name": "é"}}] * 4


def test_shared_folder_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = materialize(spark.range(10).withColumn("x", F.array(F.col("id"))), "t")
    assert df.count() == 10 and shared_dir(spark) in df.inputFiles()[0]


def test_latest_object_versions(spark):
    versions = spark.createDataFrame(
        [("b", "a.csv", "v1", False, False), ("b", "a.csv", "v2", True, False), ("b", "a.csv", "m1", True, True),
         ("b", "a.csv.bak", "v9", True, False), ("b", "gone.csv", "m2", True, True), ("c", "a.csv", "v7", False, False)],
        "bucket string, key string, version_id string, is_latest boolean, is_delete_marker boolean",
    )
    expected = {
        "s3a://b/a.csv": "v2", "s3://b//a.csv": "v2", "s3n://b/gone.csv": "m2", "s3a://b/none.csv": "N/A",
        "s3a://c/a.csv": "N/A", "https://b/a.csv": None, "s3a://b": None, "": None,
    }
    requests = spark.createDataFrame([(p,) for p in expected], "path string")
    got = {r["path"]: r["version_id"] for r in objects.object_latest_version(versions, requests).collect()}
    assert got == expected


def test_file_inventory(spark):
    path = scratch_path(spark, "inventory")
    spark.range(10).repartition(3).write.parquet(path)
    files = objects.file_inventory(spark, path)
    assert files.filter("path like '%.parquet'").count() == 3


def test_registry_lookups(spark):
    versions = spark.createDataFrame(
        [("m", 1, "Production", "r1", 10, 0.5, {"k": "a"}), ("m", 2, "Production", "r2", 5, 0.6, {"k": "b"}),
         ("m", 3, None, "r3", 20, 0.9, {"k": "c"}), ("n", 1, None, "r4", 1, None, {"k": "d"})],
        "name string, version long, stage string, run_id string, last_updated_timestamp long, accuracy double, tags map<string, string>",
    )
    names = spark.createDataFrame([("m",), ("absent",)], "name string")
    assert {r["name"]: r["version"] for r in registry.latest_model_version(versions, names).collect()} == {"m": 3, "absent": None}
    assert [(r["name"], r["version"]) for r in registry.model_version_by_stage(versions).collect()] == [("m", 2)]
    assert registry.all_model_versions(versions, "m").count() == 3


def test_promotion_tags_the_source_and_copies_it_to_production(spark):
    versions = spark.createDataFrame(
        [("m", 1, None, "r1", 10, 0.5, {"Production": "True", "k": "a"}), ("m", 2, None, "r2", 5, 0.6, None),
         ("n", 7, None, "r3", 20, 0.9, {"k": "c"}), ("live", 4, "Production", "r4", 1, None, {"k": "d"})],
        "name string, version long, stage string, run_id string, last_updated_timestamp long, accuracy double, tags map<string, string>",
    )
    decisions = spark.createDataFrame(
        [("m", 1, "live", "promote"), ("m", 2, "live", "promote"), ("n", 7, "first", "promote"), ("n", 7, "live", "keep")],
        "name string, source_version long, destination string, decision string",
    )
    rows = registry.promote_version(versions, decisions, F.lit(99)).collect()
    found = {(r["name"], r["version"]): (r["stage"], r["run_id"], r["tags"]) for r in rows}
    yes = {"Production": "True"}
    assert len(rows) == 7 and found == {
        ("m", 1): (None, "r1", {"k": "a", **yes}), ("m", 2): (None, "r2", yes), ("n", 7): (None, "r3", {"k": "c", **yes}),
        ("live", 4): ("Production", "r4", {"k": "d"}), ("live", 5): ("Production", "r1", {"k": "a", **yes}),
        ("live", 6): ("Production", "r2", yes), ("first", 1): ("Production", "r3", {"k": "c", **yes}),
    }


@pytest.mark.parametrize("bytes_per_split", [1 << 27, 400])
def test_first_row_goes_by_its_place(spark, tmp_path, bytes_per_split):
    from tonewatch.sources import row_numbers

    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("".join(f"{name},{i},text {i % 3}\n" for i in range(900)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(bytes_per_split))
    try:
        scan = csv_tables.read_csv(spark, str(tmp_path), "f string, i int, t string", header=False)
        assert scan.rdd.getNumPartitions() >= (40 if bytes_per_split == 400 else 1)
        rows = row_numbers.numbered(scan).collect()
        rest = row_numbers.drop_first_row(scan).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["f"], r["ordinal"]) for r in rows) == sorted((f, i) for f in "ab" for i in range(900))
    assert all(r["ordinal"] == r["i"] for r in rows)
    assert sorted((r["f"], r["i"]) for r in rest) == sorted((f, i) for f in "ab" for i in range(1, 900))


def test_stages_are_counted_by_one_execution(spark):
    from tonewatch.operators import observed
    from tonewatch.session import materialize

    rows = [("p", "Positive", "fine words"), ("p", "Other", "x"), ("p", "", "y"), ("p", "Negative", None), ("p", "Neutral", "  "), ("p", "Neutral", "12 34")]
    clean, counts = observed.counted_stages(spark.createDataFrame(rows, "Product string, Label string, Text string"))
    written = materialize(clean, "counted")
    assert [(r["stage"], r["rows"], r["dropped"]) for r in counts().orderBy("place").collect()] == [
        ("input", 6, 0), ("drop_null_text", 5, 1), ("filter_not_blank", 3, 2), ("filter_known_label", 2, 1), ("clean_text", 1, 1),
    ]
    assert written.count() == 1
    made = written.mapInArrow(lambda batches: batches, written.schema)  # observations do not stay in the way of later tasks
    assert made.count() == 1


def test_runs_are_seen_whole_or_not_at_all(spark, tmp_path):
    from tonewatch.sources import committed

    path, kind = str(tmp_path / "runs"), "run string, n int"

    def made(run, numbers):
        return spark.createDataFrame([(run, n) for n in numbers], kind)

    def seen():
        return sorted(map(tuple, committed.read_runs(spark, path, made("x", []).schema).collect()))

    assert seen() == []
    committed.write_run(made("a", [1]), path, "a")  # ended before its commit
    assert seen() == []
    committed.append_run(made("a", [1, 2]), path, "a")
    committed.append_run(made("b", [3]), path, "b")
    assert seen() == [("a", 1), ("a", 2), ("b", 3)]
    broken = made("a", [7]).selectExpr("run", "raise_error('lost') as n")
    with pytest.raises(Exception, match="lost"):
        committed.append_run(broken, path, "a")
    assert seen() == [("a", 1), ("a", 2), ("b", 3)]
    committed.append_run(made("a", [8]), path, "a")
    assert seen() == [("a", 8), ("b", 3)] and set(committed.committed_runs(spark, path)) == {"a", "b"}
    assert committed.drop_uncommitted(spark, path) >= 2 and seen() == [("a", 8), ("b", 3)]
    with pytest.raises(ValueError):
        committed.append_run(made("a", [8]), path, "a/b")
