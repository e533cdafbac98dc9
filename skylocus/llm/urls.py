"""URL filter: listed rules first, then gradient-boosted trees on lexical features.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from
there up to ``?``, ``#`` or the end. A rule ``host/path`` fits its host and every subdomain when the
url's path starts with the rule's; the longest wins, of equally long ones that with the longer host.

The trees are trained on labelled urls, at most ``max_train`` of them, those of smallest hash: lengths,
depth, digit ratio, entropy, parameter counts, and the smoothed share of blocked urls of the host's
last label and last two labels among the labelled ones. Without labels of both kinds every url gets
the one kind there is, or ``allow``.

Cases: a null url, or one without ``://``, has an empty host and path and fits no rule; the trees judge
its text as it stands (null: empty). Repeated rows each give a row; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TRAIN = 20_000
#: The rules of the registered query: (rule, verdict).
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = str.maketrans(_UPPER, _LOWER)
_PARTS = re.compile(r"([^/?#]*)([^?#]*)", re.S)


def split_url(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host, path = _PARTS.match(rest).groups()
    return host.translate(_LOW), path


class Rules:
    """Rules by host, so that a url looks up only its own host's suffixes."""

    def __init__(self, rules: Sequence[tuple[str, str]]) -> None:
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.translate(_LOW), []).append((slash + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best, labels = None, host.split(".") if host else []
        for k in range(len(labels)):
            suffix = ".".join(labels[k:])
            for start, rule, verdict in self.by_host.get(suffix, ()):
                if path.startswith(start):
                    best = max(best or (0,), (len(rule), len(suffix), rule, verdict))
        return (best[2], best[3]) if best else None


def suffixes(host: str) -> tuple[str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:])


def lexical(url: str, host: str, path: str, shares: dict[str, float], base: float) -> list[float]:
    n = max(1, len(url))
    counts = Counter(url)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    query = url.partition("?")[2].partition("#")[0]
    params = [p for p in query.split("&") if p]
    last, two = suffixes(host)
    return [
        len(url), len(host), len(path), path.count("/"), host.count("."), host.count("-"),
        sum(c.isdigit() for c in url) / n, sum(c.isdigit() for c in path), entropy,
        len(params), len(query), float("#" in url), max([0, *map(len, path.split("/"))]),
        shares.get(last, base), shares.get(two, base),
    ]


@dataclass
class Tree:
    """A complete tree in heap order; a leaf's feature is -1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            right = x[rows, np.maximum(f, 0)] > self.cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)


def grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: float = 5.0, ridge: float = 1.0) -> Tree:
    """One tree by the largest second-order gain over binned cuts."""
    size = 2 ** (depth + 1) - 1
    feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
    held = {0: np.arange(len(x))}
    for at in range(size):
        rows = held.pop(at, None)
        if rows is None:
            continue
        gs, hs = g[rows].sum(), h[rows].sum()
        value[at] = -gs / (hs + ridge)
        best = (1e-6, -1, 0)
        if 2 * at + 2 < size and len(rows) >= 2 * least:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = bins[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(b, v, len(e) + 1))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(nl < least) | (len(rows) - nl < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
        if best[1] >= 0:
            _, f, k = best
            feature[at], cut[at] = f, edges[f][k]
            right = bins[rows, f] > k
            held[2 * at + 1], held[2 * at + 2] = rows[~right], rows[right]
    return Tree(feature, cut, value)


@dataclass
class Model:
    base: float
    shares: dict[str, float]
    prior: float
    trees: list[Tree]
    rate: float = 0.2

    def block_prob(self, urls: Sequence[str]) -> np.ndarray:
        if not len(urls):
            return np.zeros(0)
        x = np.array([lexical(u, *split_url(u), self.shares, self.prior) for u in urls], np.float64)
        score = np.full(len(urls), self.base)
        for tree in self.trees:
            score += self.rate * tree(x)
        return 1 / (1 + np.exp(-score))


def fit(urls: Sequence[str], blocked: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, smooth: float = 20.0) -> Model:
    """Logistic boosting."""
    y = np.asarray(blocked, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(20.0 if len(y) and y[0] else -20.0, {}, 0.0, [])
    prior = float(y.mean())
    total: dict[str, list[float]] = {}
    for url, label in zip(urls, y):
        for s in set(suffixes(split_url(url)[0])):
            seen = total.setdefault(s, [0.0, 0.0])
            seen[0] += label
            seen[1] += 1
    shares = {s: (b + smooth * prior) / (n + smooth) for s, (b, n) in total.items()}
    x = np.array([lexical(u, *split_url(u), shares, prior) for u in urls])
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    base = math.log(prior / (1 - prior))
    score, grown = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = grow(x, bins, edges, p - y, p * (1 - p), depth)
        score += rate * tree(x)
        grown.append(tree)
    return Model(base, shares, prior, grown, rate)


def train(labelled: DataFrame, max_train: int = MAX_TRAIN, url_col: str = "url", verdict_col: str = "verdict") -> Model:
    """Fit on at most ``max_train`` labelled urls; a url counts once for each verdict it has."""
    known = labelled.where(F.col(url_col).isNotNull() & F.col(verdict_col).isin("allow", "block"))
    once = known.groupBy(F.col(url_col).alias("u"), F.col(verdict_col).alias("v")).agg(F.count("*").alias("n"))
    rows = once.orderBy(F.xxhash64("u"), "u", "v").limit(max_train).select("u", "v").collect()
    rows = sorted((r.u, r.v) for r in rows)
    return fit([u for u, _ in rows], np.array([v == "block" for _, v in rows]))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def by_rules(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, url, host, path, rule and the rule's verdict (null without a rule)."""
    known = Rules(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [known.find(h, p) or (None, None) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            more = [pa.array([f[k] for f in found], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "rule", "verdict"])

    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    kind = pages.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, url string, host string, path string, rule string, verdict string")


def judge(pages: DataFrame, model: Model, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", most: float = 0.5) -> DataFrame:
    """``id_col``, host, path, rule, verdict, block_prob (the trees' probability, whatever the rule says). Only the url column is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.block_prob([u or "" for u in batch.column("url").to_pylist()])
            verdict = [v or ("block" if x >= most else "allow") for v, x in zip(batch.column("verdict").to_pylist(), p)]
            columns = [batch.column(c) for c in ("id", "host", "path", "rule")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(verdict, pa.string()), pa.array(p, pa.float64())], names=["id", "host", "path", "rule", "verdict", "block_prob"])

    kind = pages.schema[id_col].dataType.simpleString()
    ruled = by_rules(pages, rules, id_col, url_col)
    return ruled.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, block_prob double").withColumnRenamed("id", id_col)
