"""Document quality by ordinal cumulative-link regression on graded ratings.

One vector of weights over hashed text features is shared by all grades, and ordered thresholds cut
the score: P(grade <= k) = 1 / (1 + exp(score - threshold[k])). The fit takes at most ``max_train``
rated documents, those of smallest hash, whole; scoring reads every document whole, in one narrow map.

Features, hashed into ``BUCKETS``: each distinct word, damped in short documents by ``DAMP``; the shapes
of words (letters, digits and marks, runs collapsed) as shares of all words; by tenths, the share of
words that repeat the word before and the share of words that are distinct.

Cases: a null text is the empty text, which has the bias feature alone. Ratings that are null, or of
ids that have no document, are left out; of several ratings of one id the lowest counts. With fewer
than two grades rated, every document gets the one grade there is, or the highest if there is none.
Repeated rows each give a row; other columns are ignored; an empty table gives an empty result. Very long
texts are read whole, words of more than ``LONG`` characters as several.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, texts, tidy

BUCKETS = 1 << 14
#: Most rated documents in the fit.
MAX_TRAIN = 6000
#: Distinct words that a document counts as having besides its own.
DAMP = 8
#: Characters beyond which a word is taken as several.
LONG = 64
#: Words whose features a worker keeps.
CACHE = 60_000

_RUNS = [(re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "0"), (re.compile(r"([^a0A])\1+"), r"\1")]


def bucket(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature.encode()) & (BUCKETS - 1)


def shape(word: str) -> str:
    """``Onha!!`` and ``ON!!`` give ``Aa!`` and ``A!``: kinds of characters in order."""
    case = "A" if word.isupper() else "Aa" if word[:1].isupper() else "a"
    for pattern, by in _RUNS:
        word = pattern.sub(by, word)
    return case + ":" + word


def split(text: str) -> list[str]:
    """The words; one of more than ``LONG`` characters counts as several of that length, to its end."""
    words = text.split()
    if max(map(len, words), default=0) > LONG:
        words = [w[k : k + LONG] for w in words for k in range(0, len(w), LONG)]
    return words


class Words(dict):
    """word -> the buckets of itself and its shape, or their weights; forgets all when full."""

    def __init__(self, weights: np.ndarray | None = None) -> None:
        self.weights = weights

    def __missing__(self, word: str):
        if len(self) >= CACHE:
            self.clear()
        found = bucket("w:" + word.lower()), bucket("s:" + shape(word))
        self[word] = got = found if self.weights is None else (float(self.weights[found[0]]), float(self.weights[found[1]]))
        return got


def whole(words: list[str], distinct: int) -> list[tuple[str, float]]:
    """Features of the document as a whole."""
    if not words:
        return [("bias", 1.0)]
    again = sum(map(str.__eq__, words, words[1:]))
    return [("bias", 1.0), (f"again:{10 * again // len(words)}", 1.0), (f"distinct:{10 * distinct // len(words)}", 1.0)]


def features(text: str, known: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in order and their values."""
    words, known = split(text), Words() if known is None else known
    share: dict[int, float] = {}
    counts = Counter(words)
    for w, n in counts.items():
        a, b = known[w]
        share[a] = share.get(a, 0.0) + 1 / (len(counts) + DAMP)
        share[b] = share.get(b, 0.0) + n / len(words)
    for k, v in whole(words, len(counts)):
        share[bucket(k)] = share.get(bucket(k), 0.0) + v
    at = sorted(share)
    return np.array(at, np.int64), np.array([share[k] for k in at])


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than the grades
    grades: np.ndarray

    def score(self, text: str) -> float:
        return self.of(split(text), Words(self.weights))

    def of(self, words: list[str], known: Words) -> float:
        # in the order of first occurrence, so that a rerun adds alike
        counts, own, form = Counter(words), 0.0, 0.0
        for w, n in counts.items():
            a, b = known[w]
            own += a
            form += b * n
        total = own / (len(counts) + DAMP) + form / max(1, len(words))
        return total + sum(float(self.weights[bucket(k)]) * v for k, v in whole(words, len(counts)))

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold, a row per score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, steps: int = 250, rate: float = 0.15, decay: float = 1e-3) -> Model:
    """Maximum likelihood by Adam over all rows at once; thresholds are ordered through their gaps."""
    grades, y = np.unique(grade, return_inverse=True)
    if len(grades) < 2:
        return Model(np.zeros(BUCKETS), np.zeros(0), grades if len(grades) else np.array([2]))
    at, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    # shares are small; scale by each bucket's spread so that one rate suits all
    n = len(rows)
    scale = 1 / np.sqrt(np.maximum(np.bincount(at, value**2, BUCKETS) / n, 1e-4))
    value = value * scale[at]
    k = len(grades)
    w = np.zeros(BUCKETS)
    share = np.cumsum(np.bincount(y, minlength=k))[:-1] / n
    cut_at = np.log(share / (1 - share))
    t = np.concatenate([cut_at[:1], np.log(np.maximum(np.diff(cut_at), 1e-3))])
    p, m, v = np.concatenate([w, t]), np.zeros(BUCKETS + k - 1), np.zeros(BUCKETS + k - 1)
    for step in range(1, steps + 1):
        w, t = p[:BUCKETS], p[BUCKETS:]
        gaps = np.exp(t[1:])
        theta = np.concatenate([t[:1], t[0] + np.cumsum(gaps)])
        score = np.bincount(row, value * w[at], n)
        edge = np.concatenate([[-60.0], theta, [60.0]])
        up, low = (1 / (1 + np.exp(-np.clip(edge[y + d] - score, -60, 60))) for d in (1, 0))
        mass = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up) / mass, low * (1 - low) / mass
        g_score = (du - dl) / n  # of the negative log likelihood
        g_edge = np.bincount(y + 1, -du / n, k + 1) + np.bincount(y, dl / n, k + 1)
        g_theta = g_edge[1:-1]
        back = np.cumsum(g_theta[::-1])[::-1]
        grad = np.concatenate([np.bincount(at, value * g_score[row], BUCKETS) + decay * w, back[:1], back[1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9) * (0.98 if step < steps // 2 else 0.3)
    t = p[BUCKETS:]
    return Model(p[:BUCKETS] * scale, np.concatenate([t[:1], t[0] + np.cumsum(np.exp(t[1:]))]), grades)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Words()
    for batch in batches:
        found = [features(x.decode("utf-8", "replace"), known) for x in texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("grade"), pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())), pa.array([f[1].astype(np.float32) for f in found], pa.list_(pa.float32()))],
            names=["id", "grade", "at", "value"],
        )


def train(docs: DataFrame, ratings: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> Model:
    """Fit on at most ``max_train`` rated documents. Only their ids (8 bytes each) are broadcast, only their features collected."""
    bound_batches(docs.sparkSession)
    rated = ratings.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(grade_col).cast("int").alias("grade"))
    # ids without a document do not use up the bound
    there = docs.select(F.col(id_col).alias("id")).distinct()
    chosen = cut(rated.join(there, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(max_train), "quality-train")
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    got = sample.mapInArrow(tidy(_featured), "id long, grade int, at array<int>, value array<float>").toArrow()
    order = np.argsort(got.column("id").to_numpy(), kind="stable")
    at, value, grade = got.column("at").to_pylist(), got.column("value").to_pylist(), got.column("grade").to_numpy()
    return fit([(np.array(at[i], np.int64), np.array(value[i])) for i in order], grade[order])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_grade: int = 1, min_tail: float = 0.5) -> DataFrame:
    """One row per document: its id, expected_grade, tail_prob = P(grade >= ``keep_grade``), kept = tail_prob >= ``min_tail``."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(model.weights)
        for batch in batches:
            s = np.array([model.of(split(x.decode("utf-8", "replace")), known) for x in texts(batch.column("text"))])
            tails = model.tails(s)
            expected = model.grades[0] + tails @ np.diff(model.grades) if len(s) else s
            above = np.searchsorted(model.grades, keep_grade)  # the first grade that is kept
            tail = np.ones(len(s)) if above == 0 else np.zeros(len(s)) if above >= len(model.grades) else tails[:, above - 1]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(expected, pa.float64()), pa.array(tail, pa.float64()), pa.array(tail >= min_tail, pa.bool_())], names=["id", "expected_grade", "tail_prob", "kept"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"id {kind}, expected_grade double, tail_prob double, kept boolean").withColumnRenamed("id", id_col)


def grades(labels: DataFrame) -> DataFrame:
    """Ratings of the ``labels`` table: 0 low quality, 1 good but toxic, 2 good."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) == 1
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & toxic, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def keep_good(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_grade: int = 1, min_tail: float = 0.5) -> DataFrame:
    """``docs`` without those that the classifier rejects; decided row by row where the text already is."""
    model = train(docs, ratings, id_col=id_col, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(model.weights)
        above = np.searchsorted(model.grades, keep_grade)
        for batch in batches:
            if 0 < above < len(model.grades):
                s = np.array([model.of(split(x.decode("utf-8", "replace")), known) for x in texts(batch.column(text_col))])
                batch = batch.filter(pa.array(model.tails(s)[:, above - 1] >= min_tail, pa.bool_()) if len(s) else pa.array([], pa.bool_()))
            elif above:
                batch = batch.slice(0, 0)
            yield batch

    return docs.mapInArrow(tidy(run), docs.schema)
