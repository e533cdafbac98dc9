"""Message codec: gzip inside base64, one message per line."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylocus.config import BatchLimits


def looks_like_json(c: Column) -> Column:
    """I-01."""
    said = F.trim(c)
    return F.coalesce(said.startswith("{") & said.endswith("}"), F.lit(False))


def valid_messages(df: DataFrame, col: str = "value") -> DataFrame:
    """I-02."""
    return df.where(looks_like_json(F.col(col)))


@F.pandas_udf(T.BinaryType())
def gzip_bytes(text: pd.Series) -> pd.Series:
    """I-03; same bytes for the same text."""
    return text.map(lambda x: None if x is None else gzip.compress(x.encode(), 6, mtime=0))


def _plain(raw: bytes | None) -> str | None:
    try:
        return None if raw is None else gzip.decompress(raw).decode("utf-8", "replace")
    except (OSError, EOFError, ValueError, zlib.error):
        return None


@F.pandas_udf(T.StringType())
def gunzip_text(raw: pd.Series) -> pd.Series:
    """T-03; what is not gzip is null."""
    return raw.map(_plain)


def encode_messages(df: DataFrame, col: str = "value") -> DataFrame:
    """I-03, I-04: adds ``encoded``."""
    return df.withColumn("encoded", F.base64(gzip_bytes(F.col(col)))).withColumn("encoded", F.regexp_replace("encoded", "[\r\n]", ""))


def decode_lines(df: DataFrame, col: str = "value") -> DataFrame:
    """T-01 to T-03: trims, drops empty and undecodable lines, adds ``message``."""
    line = F.trim(F.col(col))
    raw = F.try_to_binary(line, F.lit("base64"))
    return df.where(F.length(line) > 0).withColumn("message", gunzip_text(raw)).where("message is not null")


def droppable(c: Column, limits: BatchLimits = BatchLimits()) -> Column:
    """I-06: too long for one record."""
    return F.octet_length(c) > limits.record_bytes


def count_batches(df: DataFrame, order: list[str], per: str, size: int) -> DataFrame:
    """I-05 by count alone: ``batch`` within each ``per``."""
    from pyspark.sql import Window

    row = F.row_number().over(Window.partitionBy(per).orderBy(*order))
    return df.withColumn("batch", F.floor((row - 1) / size).cast("long"))


def greedy_batches(df: DataFrame, per: str, order: list[str], col: str, limits: BatchLimits = BatchLimits()) -> DataFrame:
    """I-05, I-12: a batch closes when it has enough records, or when the next would exceed its bytes.

    Rows are dealt by ``per`` (a stream shard) and pass one task in order as a stream; only the running
    count and bytes are held.
    """
    most_n, most_b = limits.records, limits.batch_bytes

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, batch, n, held = object(), 0, 0, 0
        for frame in frames:
            out = []
            for key, size in zip(frame[per].to_numpy(), frame["_bytes"].to_numpy()):
                if key != shard:
                    shard, batch, n, held = key, 0, 0, 0
                if n and (n >= most_n or held + size > most_b):
                    batch, n, held = batch + 1, 0, 0
                n, held = n + 1, held + int(size)
                out.append(batch)
            yield frame.drop(columns="_bytes").assign(batch=out)

    sized = df.where(~F.coalesce(droppable(F.col(col), limits), F.lit(True))).withColumn("_bytes", F.octet_length(col).cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", batch long"
    return sized.repartition(per).sortWithinPartitions(per, *order).mapInPandas(run, schema)


def codec_stats(df: DataFrame, col: str = "value") -> DataFrame:
    """S-03, S-20: bytes before and after, and whether the text survives the round trip."""
    out = decode_lines(encode_messages(df, col), "encoded")
    sizes = [F.sum(F.octet_length(c).cast("long")).alias(a) for c, a in ((col, "original_bytes"), ("encoded", "encoded_bytes"))]
    return out.agg(F.count("*").alias("messages"), *sizes, F.bool_and(F.col("message") == F.col(col)).alias("intact"))
