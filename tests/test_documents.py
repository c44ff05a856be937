"""Documents joined from the parts of many tasks."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from wavemill.operators import relational as R
from wavemill.sinks.documents import write_document
from wavemill.sources import readers


def test_document_is_read_back_in_order(spark, tmp_path):
    path = str(tmp_path / "new" / "d.json")
    rows = spark.range(1000).select(F.col("id").cast("int").alias("sample_idx"), F.when(F.col("id") % 3 > 0, F.format_string('"a" é\n%d', "id")).alias("target_answer"), F.create_map(F.lit("accuracy"), (F.col("id") % 2).cast("double")).alias("metrics"))
    ordered = rows.repartition(7).orderBy("sample_idx")
    summary = rows.agg(F.lit("m").alias("model_name"), F.lit("d").alias("dataset_name"), F.count(F.lit(1)).alias("n"))
    write_document(ordered, path, summary)
    said = json.load(open(path))
    assert [r["sample_idx"] for r in said["detailed_results"]] == list(range(1000)) and (said["model_name"], said["n"]) == ("m", 1000)
    assert said["detailed_results"][1] == {"sample_idx": 1, "target_answer": '"a" é\n1', "metrics": {"accuracy": 1.0}} and said["detailed_results"][0]["target_answer"] is None
    back = readers.detailed_results(spark, path)
    assert back.count() == 1000 and back.where("model_name = 'm' AND sample_idx = 5").first()["metrics"] == {"accuracy": 1.0}
    assert os.listdir(tmp_path / "new") == ["d.json"]


def test_parts_follow_their_rank(spark, tmp_path):
    """What each worker wrote stands in the order of the workers."""
    parts = [spark.createDataFrame([(f"{k}{x}",) for x in "ba"], "v string").coalesce(1) for k in (2, 0, 1)]
    write_document(R.ordered_union(*parts), str(tmp_path / "d.json"), field="rows")
    assert [(r["part"], r["v"]) for r in json.load(open(tmp_path / "d.json"))["rows"]] == [(0, "2b"), (0, "2a"), (1, "0b"), (1, "0a"), (2, "1b"), (2, "1a")]


def test_failing_task_leaves_the_old_document(spark, tmp_path):
    path = str(tmp_path / "d.json")
    write_document(spark.range(2), path)
    old = open(path).read()
    bad = spark.range(100).repartition(5).select(F.when(F.col("id") == 77, F.raise_error(F.lit("row 77"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="row 77"):
        write_document(bad, path)
    assert open(path).read() == old and os.listdir(tmp_path) == ["d.json"]
    with pytest.raises(Exception, match="mode overwrite"):
        write_document(spark.range(1), path, overwrite=False)
    assert open(path).read() == old


def test_empty_and_odd_documents(spark, tmp_path):
    path = str(tmp_path / "d.json")
    write_document(spark.range(0), path, overwrite=False)
    assert json.load(open(path)) == {"detailed_results": []}
    write_document(spark.createDataFrame([(dt.date(2024, 1, 2), [1.5, None])], "d date, v array<double>"), path)
    assert json.load(open(path))["detailed_results"] == [{"d": "2024-01-02", "v": [1.5, None]}]
    with pytest.raises(Exception, match="without the field"):
        write_document(spark.range(1), path, spark.range(1).toDF("detailed_results"))


def test_document_rows_are_read_by_splits(spark, tmp_path):
    """many tasks read one document."""
    path = str(tmp_path / "d.json")
    write_document(spark.range(500).select("id", F.format_string('a,\n%d"]},', "id").alias("t")).repartition(5).orderBy("id"), path, spark.range(1).toDF("n"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        read = readers.document_rows(spark, path, "id long, t string")
        assert [(r["place"], *r["r"]) for r in read.orderBy("place").collect()] == [(k, k, f'a,\n{k}"]}},') for k in range(500)]
        assert spark.read.text(path).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    write_document(spark.range(0), path)
    assert readers.document_rows(spark, path, "id long").count() == 0
