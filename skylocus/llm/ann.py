"""Nearest neighbours by an inverted file with product-quantised residuals and exact reranking.

Coarse centroids and residual codebooks are fitted on at most ``SAMPLE`` vectors, those of smallest
hash of id; every vector is indexed. The number of lists that a query probes is measured on the sample
for at most ``TRIALS`` of the queries, those of smallest hash of id, as queries may lie elsewhere than most rows:
the least that holds all their true neighbours within it for ``COVER`` of them, copies left out, which is harder there than among all
vectors, where neighbours are closer. A query scores the codes of its nearest lists by an
asymmetric distance table. With each code its error is kept, so it bounds the distance from below and above: of each piece of a list
the best ``rerank`` are measured exactly in double precision, and all others that may be among the nearest of the piece.
Lists and codes are those of vectors shifted to the sample's mean and scaled to its largest component, so neither
a common offset nor very small or large vectors lose their digits. A list of more than ``PIECE`` vectors is dealt over pieces by a hash of the id, and queries
of one list over blocks of ``BLOCK``, so that no task holds more of either.

Cases: vectors that are null, zero, of another length than most, or that hold null or non-finite
components, and rows without id, take no part. A query's own id is no candidate. Ties go to the smaller
id. Lists are probed until they hold enough candidates, all of them if need be. Rows that repeat an id
are candidates each, but one query. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut

SAMPLE = 20_000
PIECE = 4096
BLOCK = 512
#: Share of queries whose true neighbours within the sample all lie in the probed lists, and the queries that measure it.
COVER, TRIALS = 0.97, 256
#: Most coarse lists; the fit needs some 20 sampled vectors for each.
LISTS = 1024


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    centers = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        near = nearest(x, centers)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(centers)
        np.add.at(total, near, x)
        centers = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centers)
    return centers


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (centers**2).sum(1)[None, :] - 2 * (x @ centers.T)


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], centers).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Codebook:
    coarse: np.ndarray  # lists x dimension
    parts: list[np.ndarray]  # of each subspace: codes x its dimension
    edges: list[int]

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The list and the codes of each vector, and the distance from what they stand for."""
        lists = nearest(x, self.coarse)
        rest = x - self.coarse[lists]
        cols = [nearest(rest[:, a:b], p) for a, b, p in zip(self.edges, self.edges[1:], self.parts)]
        lost = sum((((rest[:, a:b] - p[c]) ** 2).sum(1) for a, b, p, c in zip(self.edges, self.edges[1:], self.parts, cols)), np.zeros(len(x)))
        return lists, np.stack(cols, 1).astype(np.uint8) if len(x) else np.zeros((0, len(self.parts)), np.uint8), np.sqrt(lost)

    def tables(self, residual: np.ndarray) -> list[np.ndarray]:
        """Squared distances of one query's residual to every code of each subspace."""
        return [((p - residual[a:b]) ** 2).sum(1) for a, b, p in zip(self.edges, self.edges[1:], self.parts)]


def fit(sample: np.ndarray, lists: int, parts: int = 16) -> Codebook:
    x = sample
    coarse = kmeans(x, lists)
    rest = x - coarse[nearest(x, coarse)]
    parts = min(parts, x.shape[1])
    edges = [round(i * x.shape[1] / parts) for i in range(parts + 1)]
    return Codebook(coarse, [kmeans(rest[:, a:b], 256) for a, b in zip(edges, edges[1:])], edges)


@dataclass(frozen=True)
class Frame:
    """Shift and scale, a power of two."""

    scale: float
    mean: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x / self.scale - self.mean


def framed(sample: np.ndarray) -> Frame:
    scale = 2.0 ** math.floor(math.log2(np.abs(sample).max()))
    return Frame(scale, (sample / scale).mean(0))


def probes_for(ids: np.ndarray, sample: np.ndarray, asks: np.ndarray, queries: np.ndarray, book: Codebook, frame: Frame, k: int, cover: float = COVER) -> int:
    """Lists to probe so that the ``k`` nearest sampled vectors lie in them for ``cover`` of ``queries`` (of ids ``asks``), ties to the smaller id."""
    by = np.argsort(ids, kind="stable")
    ids, sample = ids[by], sample[by]
    of, x, q = nearest(frame(sample), book.coarse), sample / frame.scale, queries / frame.scale
    needed = []
    for own, v, near in zip(asks, q, distances(frame(queries), book.coarse)):
        rank = np.empty(len(near), np.int64)
        rank[np.argsort(near, kind="stable")] = np.arange(len(near))
        far = ((x - v) ** 2).sum(1)
        others = np.flatnonzero((ids != own) & (far > 0))  # its copies share its list
        if len(others):
            needed.append(rank[of[others[np.argsort(far[others], kind="stable")[:k]]]].max())
    if not needed:
        return len(book.coarse)
    needed.sort()
    return int(needed[max(0, math.ceil(cover * len(needed)) - 1)]) + 1


def usable(vec: Column, dim: int) -> Column:
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) == dim) & fine & F.exists(vec, lambda x: x != 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def search(vectors: DataFrame, every: int = 100, k: int = 10, rerank: int = 128, probes: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where("vec_id is not null")
    common = rows.where("vec is not null and size(vec) > 0").groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not common:
        return spark.createDataFrame([], out)
    dim = common[0]["dim"]
    rows = rows.where(usable(F.col("vec"), dim))
    bound_batches(spark, 2048)
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    if not total:
        return spark.createDataFrame([], out)
    lists = max(1, min(LISTS, SAMPLE // 20, round(math.sqrt(total))))
    held = _matrix(sample.column("vec").combine_chunks(), dim)
    frame = framed(held)
    book = fit(frame(held), lists)
    lists = len(book.coarse)
    if not probes:
        trial = rows.where(F.col("vec_id") % every == 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRIALS).toArrow()
        asks, queries = trial.column("vec_id").to_numpy(), _matrix(trial.column("vec").combine_chunks(), dim)
        probes = probes_for(sample.column("vec_id").to_numpy(), held, asks, queries, book, frame, k)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"), dim)
            at, code, lost = book.code(frame(x))
            codes = [c.tobytes() for c in code]
            arrays = [pa.array(at, pa.int32()), pa.array(codes, pa.binary()), pa.array(lost, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), *arrays], names=["vec_id", "vec", "list", "code", "lost"])

    indexed = cut(rows.mapInArrow(index, "vec_id long, vec array<double>, list int, code binary, lost double"), "ann-index")
    # one number per list: bounded by LISTS
    sizes = np.zeros(lists, np.int64)
    for r in indexed.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    pieces = np.maximum(1, -(-sizes // PIECE))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column("query_id").to_pylist(), _matrix(batch.column("vec"), dim)
            order = np.argsort(distances(frame(x), book.coarse), axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            enough = np.argmax(held >= min(total, k + 1), axis=1) + 1  # itself is among them
            n = [max(min(probes, lists), int(e)) for e in enough]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, n), pa.int64()), batch.column("vec").take(pa.array(np.repeat(np.arange(len(ids)), n))), pa.array(np.concatenate([o[:m] for o, m in zip(order, n)]) if ids else [], pa.int32())],
                names=["query_id", "vec", "list"],
            )

    asked = indexed.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec"))
    probed = cut(asked.mapInArrow(probe, "query_id long, vec array<double>, list int"), "ann-probes")
    askers = np.zeros(lists, np.int64)
    for r in probed.groupBy("list").count().collect():
        askers[r["list"]] = r["count"]
    blocks = np.maximum(1, -(-askers // BLOCK))

    def at(counts: np.ndarray) -> Column:
        return F.element_at(F.array(*map(F.lit, counts.tolist())), F.col("list") + 1)

    left = indexed.withColumn("piece", F.pmod(F.xxhash64("vec_id"), at(pieces))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), at(blocks) - 1)))
    right = probed.withColumn("block", F.pmod(F.xxhash64("query_id"), at(blocks))).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), at(pieces) - 1)))

    def best(held: pa.Table, asks: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if held.num_rows and asks.num_rows:
            ids = held.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], _matrix(held.column("vec").combine_chunks(), dim)[order]
            lost = held.column("lost").to_numpy()[order]
            code = np.frombuffer(b"".join(held.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            center = book.coarse[held.column("list")[0].as_py()]
            for q, v in zip(asks.column("query_id").to_pylist(), _matrix(asks.column("vec").combine_chunks(), dim)):
                near = np.zeros(len(ids))
                for j, table in enumerate(book.tables(frame(v) - center)):
                    near += table[code[:, j]]
                near = np.sqrt(near)
                other = np.flatnonzero(ids != q)
                near, off = near[other], lost[other]
                if not len(other):
                    continue
                # no farther than the k nearest can be, but for rounding
                most = np.sort(near + off)[min(k, len(other)) - 1] + 1e-12 * (1 + near.max())
                may = ~(near - off > most)
                may[np.argsort(near, kind="stable")[:rerank]] = True
                top = other[may]
                exact = np.sqrt(((x[top] - v) ** 2).sum(1))
                for i in np.argsort(exact, kind="stable")[:k]:
                    found.append((q, int(ids[top[i]]), float(exact[i])))
        columns = list(zip(*found)) or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    keys = ["list", "piece", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
