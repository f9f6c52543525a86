from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from lodestone.sources import export, repository, views
from lodestone.streaming import ingest


def test_stream_appends_each_event_once(spark, tmp_path):
    rows = [(1, "p", "k", "h", "2024-01-01"), (2, "p", "k", "h", "2024-01-02"), (3, None, "k", "h", "2024-01-03")]
    schema = "id long, project_id string, kind string, content_hash string, occurred_at timestamp_ntz"
    spark.createDataFrame(rows, "id long, project_id string, kind string, content_hash string, occurred_at string").withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz")).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ingest.appended(stream, str(tmp_path / "log"), str(tmp_path / "state")).start().awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [1, 3]


def test_snapshot_hashes_and_exclusions(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_bytes(b"print()\n")
    (tmp_path / "id_rsa").write_bytes(b"secret")
    (tmp_path / "big.bin").write_bytes(b"x" * 2000)
    got = {r.path: r for r in repository.snapshot(spark, str(tmp_path), most_bytes=1000).collect()}
    assert got["src/a.py"].blob == hashlib.sha1(b"blob 8\0print()\n").hexdigest()
    assert (got["id_rsa"].skipped, got["id_rsa"].blob) == ("excluded", None) and got["big.bin"].skipped == "too_large"


def test_index_listing(spark):
    text = f"100644 {'a' * 40} 0\tsrc/x y.py" + "\0" + f"100755 {'b' * 40} 0\tbin/run" + "\0"
    row = spark.createDataFrame([(text,)], "t string").select(repository.index_entries(F.col("t")).alias("e")).first()
    assert [(x.mode, x.path) for x in row.e] == [("100644", "src/x y.py"), ("100755", "bin/run")]


def test_export_is_ordered(spark):
    got = export.pages(views.memories(spark, "/root/testdata/sf0.001")).collect()
    pages = [r.page for r in got]
    assert sorted(set(pages), key=pages.index) == ["episodic", "semantic", "procedural", "decision", "failure", "preference"]
    assert all("\n" not in r.line for r in got)
