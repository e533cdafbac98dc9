"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, tidy

#: Edges that one task settles, 16 MB of them; also the nodes that a task holds before it passes on what it knows.
ENOUGH = 1 << 20


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of the same components as the task's edges, one for each node but the smallest: b the smallest node known."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def out() -> pa.RecordBatch:
        pairs = [(x, r) for x in list(up) if (r := root(x)) != x]
        up.clear()
        a, b = zip(*pairs) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > ENOUGH:
            yield out()
    yield out()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component, for the nodes of ``edges`` (a, b) that are not it.

    Every task first puts a tree in place of its own edges. Then edges are dealt to fewer and fewer tasks,
    as many as hold ``ENOUGH`` each, while that leaves clearly fewer; if they come down to ``ENOUGH`` in all,
    one task settles them, else rounds of joins do.
    """
    own = cut(edges.select("a", "b").mapInArrow(tidy(forest), "a long, b long"), "cc-trees")
    left = own.count()
    while left > ENOUGH:
        fewer = cut(own.repartition(-(-left // ENOUGH), "a").mapInArrow(tidy(forest), "a long, b long"), "cc-trees")
        release(edges.sparkSession, own)
        own, was, left = fewer, left, fewer.count()
        if left > 0.7 * was:
            return _rounds(own)
    return cut(own.coalesce(1).mapInArrow(tidy(forest), "a long, b long").toDF("node", "label"), "cc-labels")


def _rounds(edges: DataFrame) -> DataFrame:
    """Labels fall to the smallest of the neighbours' and then to their label's own label, until none changes.

    Each round joins edges to labels and is written to the shared folder; a node of many edges is
    pre-aggregated where its edges lie.
    """
    spark = edges.sparkSession
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    after = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "cc-labels")
    while True:
        labels = after.select("node", "label")
        seen = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("seen"))
        lower = labels.join(seen, labels.node == seen.a).select("node", "label", F.least("label", "seen").alias("low"))
        of = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        now = cut(lower.join(of, "low", "left").select("node", F.col("label").alias("was"), F.least("low", "jump").alias("label")), "cc-labels")
        release(spark, after)
        after = now
        if after.where("label <> was").isEmpty():
            release(spark, both)
            return after.select("node", "label").where("label <> node")
