"""Streams over tables that are folders of files, not one file."""

import os

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_stream_clusters_of_a_folder(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    query = entry.queries()["stream_clusters"]
    want = sorted(map(tuple, query(spark, SF).collect()))
    assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == want and len(want) == e.count()


def test_event_stream_of_a_folder(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    query = entry.queries()["stream_first_seen"]
    assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == sorted(map(tuple, query(spark, SF).collect()))
    assert os.path.isdir(tmp_path / "events.parquet")
