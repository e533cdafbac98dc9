"""Exact duplicates by Grace hash deduplication.

Texts are equal when identical after lower-casing A-Z only (null counts as empty). Each input
partition first collapses its own copies, so that a text held by a third of all rows is sent at most
once per input partition; the collapsed records are then dealt by content hash and every partition
runs a Grace hash table: records go into an open-addressing table that compares whole contents, and
when the table outgrows its memory they are split by the next byte of their hash into spill files,
each of which is treated the same way.

Cases: null text is the empty text, and all empty texts are one group. Null ids never win; a group of
nothing but null ids keeps none. Rows that repeat an id share its verdict and each count in
``group_size``. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, fresh, texts, tidy

#: Bytes of content that one table holds before it spills.
TABLE_BYTES = 32 << 20
#: Spill files of one split.
FANOUT = 16
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of content in one output batch.
OUT_BYTES = 8 << 20

Record = tuple[bytes, bytes, int | None, int, int]  # digest, content, largest id, rows, rows of that id


class OpenTable:
    """Open addressing with linear probing; equal digests are confirmed on the whole content."""

    def __init__(self) -> None:
        self.slots: list[int] = [-1] * 1024
        self.entries: list[list] = []
        self.size = 0

    def add(self, digest: bytes, content: bytes, top: int | None, rows: int, twins: int) -> None:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[24:], "big") & mask
        while (k := self.slots[at]) >= 0:
            entry = self.entries[k]
            if entry[0] == digest and entry[1] == content:
                entry[3] += rows
                if top == entry[2]:
                    entry[4] += twins
                elif entry[2] is None or top is not None and top > entry[2]:
                    entry[2], entry[4] = top, twins
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.entries)
        self.entries.append([digest, content, top, rows, twins])
        self.size += len(content) + 200
        if 2 * len(self.entries) > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for k, entry in enumerate(self.entries):
            at = int.from_bytes(entry[0][24:], "big") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def grace(records: Iterable[Record], memory: int = TABLE_BYTES, fanout: int = FANOUT, level: int = 0) -> Iterator[Record]:
    """One record for each distinct content: its largest id and its number of rows.

    Holds at most ``memory`` bytes of content, or one record. Spill files are unnamed and go with
    the task; ``level`` picks the byte of the digest by which records are split.
    """
    found, files = OpenTable(), []
    for record in records:
        if files:
            pickle.dump(record, files[record[0][level] % fanout], protocol=5)
            continue
        found.add(*record)
        if found.size > memory and len(found.entries) > 1 and level < 24:
            files = [tempfile.TemporaryFile() for _ in range(fanout)]
            for entry in found.entries:
                pickle.dump(tuple(entry), files[entry[0][level] % fanout], protocol=5)
            found = OpenTable()
    for entry in found.entries:
        yield tuple(entry)
    del found
    for file in files:
        with file:
            file.seek(0)
            yield from grace(_unspill(file), memory, fanout, level + 1)


def _unspill(file) -> Iterator[Record]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [hashlib.sha256(x.lower()).digest() for x in texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], names=["id", "digest"])


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[Record]:
        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), texts(batch.column("text"))):
                low = text.lower()
                yield hashlib.sha256(low).digest(), low, i, 1, 1

    yield from _batches(grace(records()), True)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[Record]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("digest", "content", "top", "rows", "twins")))

    yield from _batches((x for x in grace(records()) if x[3] > 1), False)


def _batches(records: Iterator[Record], content: bool) -> Iterator[pa.RecordBatch]:
    kinds = {"digest": pa.binary(), "content": pa.binary(), "top": pa.int64(), "rows": pa.int64(), "twins": pa.int64()}
    held, size = [], 0

    def out() -> pa.RecordBatch:
        columns = dict(zip(kinds, zip(*held)))
        if not content:
            columns.pop("content")
        return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in columns.items()], names=list(columns))

    for record in records:
        held.append(record)
        size += len(record[1]) + 60
        if size > OUT_BYTES:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _classes(rows: DataFrame) -> DataFrame:
    """digest, top, rows, twins: the largest id, number of rows and of those of that id of each content that several rows hold; whole contents are compared."""
    partial = rows.mapInArrow(tidy(_collapse), "digest binary, content binary, top long, rows long, twins long")
    return cut(partial.repartition("digest").mapInArrow(tidy(_merge), "digest binary, top long, rows long, twins long"), "exact-classes")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. Scale: whole texts cross the network once;
    groups of one row need no entry in the class table, and the join back sends only ids and digests,
    which Spark may split when one digest is hot.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    members = rows.mapInArrow(tidy(_digests), "id long, digest binary")
    joined = members.join(_classes(rows), "digest", "left")
    alone = F.col("rows").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.col("top"))
    return joined.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("rows", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("id") == keep, F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text, one of its largest id; all columns stay as they are.

    Decided row by row, so ids may repeat, with equal or unlike texts; a text that only rows without id
    hold keeps one of them.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    given = F.col(id_col).cast("long")
    digest, of, top = (fresh(docs, f"text_{x}") for x in ("digest", "of", "top"))
    rows = docs.select(given.alias("id"), F.col(text_col).cast("string").alias("text"))
    classes = _classes(rows)
    own = F.sha2(F.encode(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, UPPER.lower()), "utf-8"), 256)
    held = docs.withColumn(digest, F.unhex(own))
    known = classes.select(F.col("digest").alias(of), F.col("top").alias(top))
    out = held.join(known, F.col(digest) == F.col(of), "left").where(F.col(of).isNull() | given.eqNullSafe(F.col(top))).drop(of, top)
    again = cut(classes.where("twins > 1").select("digest"), "exact-twins")
    if not again.isEmpty():  # rows that repeat the id that stays
        twin = F.col(digest) == F.col(of)
        again = again.withColumnRenamed("digest", of)
        out = out.join(again, twin, "left_anti").unionByName(out.join(again, twin, "left_semi").dropDuplicates([digest]))
    return out.drop(digest)


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       coalesce(doc_id = max(doc_id) OVER w, false) AS kept, sha256(low) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents)
WINDOW w AS (PARTITION BY low)
"""
