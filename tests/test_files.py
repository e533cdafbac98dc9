import datetime as dt

from pyspark.sql import functions as F
from skylocus.sources import files
from skylocus.streaming import pipeline

DAYS = [dt.datetime(2024, 1, d, 12) for d in (1, 2, 3)]


def lines(spark, n=30):
    return spark.createDataFrame([(f"aa:{i % 4},{DAYS[i % 3].isoformat()},{i}",) for i in range(n)], "value string")


def parsed(df):
    part = F.split("value", ",")
    return df.select(part[0].alias("bssid"), part[1].cast("timestamp").alias("ingestion_timestamp"), part[2].cast("int").alias("n"))


def test_lines_are_written_in_bounded_files_and_large_files_are_left(spark, tmp_path):
    files.write_lines(lines(spark).coalesce(1), str(tmp_path / "in"), per_file=10)
    assert len(list((tmp_path / "in").glob("*.txt"))) == 3
    (tmp_path / "in" / "large.txt").write_text("x" * 5000 + "\n")
    (tmp_path / "in" / "other.csv").write_text("y\n")
    got = files.landed_lines(spark, str(tmp_path / "in"), max_bytes=4000)
    assert sorted(r.value for r in got.collect()) == sorted(r.value for r in lines(spark).collect())
    assert files.landed_lines(spark, str(tmp_path / "in")).count() == 31


def test_records_too_long_for_the_sink_are_dropped(spark):
    rows = spark.createDataFrame([("a", None), ("b", "x" * 100)], "k string, v string")
    assert [r.value for r in files.json_records(rows, max_bytes=50).collect()] == ['{"k":"a"}']


def test_lake_read_opens_only_the_days_asked_for(spark, tmp_path):
    files.write_lake(parsed(lines(spark)), str(tmp_path / "lake"))
    assert files.read_lake(spark, str(tmp_path / "lake")).count() == 30
    late = files.read_lake(spark, str(tmp_path / "lake"), since="2024-01-03")
    assert sorted(r.n for r in late.collect()) == [i for i in range(30) if i % 3 == 2]
    assert all("ingest_date=2024-01-03" in r.f for r in late.select(F.input_file_name().alias("f")).distinct().collect())
    assert "PartitionFilters: [isnotnull(ingest_date" in late._jdf.queryExecution().toString()


def test_stream_reads_each_landed_file_once(spark, tmp_path):
    src, lake, log = (str(tmp_path / d) for d in ("in", "lake", "log"))
    for more in (30, 45):  # the second run finds old files and new ones
        files.write_lines(lines(spark, more), src)
        pipeline.write_lake_stream(parsed(files.landed_stream(spark, src)), lake, log, once=True).awaitTermination(60)
    pipeline.write_lake_stream(parsed(files.landed_stream(spark, src)), lake, log, once=True).awaitTermination(60)
    got = sorted(r.n for r in files.read_lake(spark, lake).collect())
    assert got == sorted([*range(30), *range(45)])


def test_stream_hands_each_batch_to_the_upsert(spark, tmp_path):
    src, seen = str(tmp_path / "in"), []
    files.write_lines(lines(spark), src)
    pipeline.upsert_stream(parsed(files.landed_stream(spark, src)), lambda batch, i: seen.append((i, batch.count())), str(tmp_path / "log")).awaitTermination(60)
    assert seen == [(0, 30)]
