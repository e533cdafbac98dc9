"""Landing files, messages and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_FILE_BYTES = 157_286_400
MAX_RECORD_BYTES = 1_024_000


def landed_lines(spark: SparkSession, path: str, glob: str = "*.txt", max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """S-08: lines of the landed files that are not too large."""
    found = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    return found.where(F.col("_metadata.file_size") <= max_bytes).select("value", F.col("_metadata.file_path").alias("file"))


def landed_stream(spark: SparkSession, path: str, glob: str = "*.txt", files_per_trigger: int = 1000) -> DataFrame:
    """S-06, S-07: new files as they arrive; the checkpoint remembers which were read."""
    return spark.readStream.option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).text(path)


def kafka_options(servers: str, topic: str, per_trigger: int = 150, tls: dict[str, str] | None = None) -> dict[str, str]:
    """S-01, S-02: options of the Kafka source; ``tls`` has the locations and passwords of the stores."""
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(per_trigger), "failOnDataLoss": "false"}
    if tls:
        out |= {"kafka.security.protocol": "SSL", **{f"kafka.ssl.{k}": v for k, v in tls.items()}}
    return out


def kafka_stream(spark: SparkSession, servers: str, topic: str, per_trigger: int = 150, tls: dict[str, str] | None = None) -> DataFrame:
    """S-01: message values; needs the Kafka connector on the class path."""
    return spark.readStream.format("kafka").options(**kafka_options(servers, topic, per_trigger, tls)).load().select(F.col("value").cast("string").alias("value"), "timestamp")


def json_records(rows: DataFrame, max_bytes: int = MAX_RECORD_BYTES) -> DataFrame:
    """S-09: each row as JSON without nulls; rows too long for the sink are dropped."""
    return rows.select(F.to_json(F.struct("*")).alias("value")).where(F.octet_length("value") <= max_bytes)


def write_lines(records: DataFrame, path: str, per_file: int = 15_000) -> None:
    """S-04: text files of bounded size."""
    records.select("value").write.mode("append").option("maxRecordsPerFile", per_file).text(path)


def write_lake(rows: DataFrame, path: str, mode: str = "append") -> None:
    """S-19: Parquet by ingestion date; one shuffle brings a day's rows together, hot days in several files."""
    dated = rows.withColumn("ingest_date", F.to_date("ingestion_timestamp"))
    dated.repartition("ingest_date", F.pmod(F.xxhash64("bssid"), F.lit(64))).write.mode(mode).partitionBy("ingest_date").parquet(path)


def read_lake(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Q-11: only the days from ``since`` on are opened."""
    rows = spark.read.parquet(path)
    return rows if since is None else rows.where(F.col("ingest_date") >= F.lit(since).cast("date"))
