import hashlib
import math
from collections import Counter

import duckdb
from pyspark.sql import functions as F
from skylocus.llm import mixing


def inverse(rate, doc, seed):
    """Copies of a document, straight from the definition."""
    parts = max(1, math.ceil(rate / mixing.STEP))
    total = 0
    for j in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}:{doc}:{j}".encode()).hexdigest()[:13], 16) / 16**13
        p = c = math.exp(-rate / parts)
        k = 0
        while c <= u and k < mixing.TERMS:
            k += 1
            p *= rate / parts / k
            c += p
            total += 1
    return total


def test_counts_are_the_inverse(spark, make_docs):
    rows = [(i, "x" * (5 + i % 7), "big") for i in range(300)] + [(1000 + i, "yy", "small") for i in range(4)] + [(2000, None, "void"), (3000, "n", None)]
    docs = make_docs(rows)
    for name in ("rate", "parts", "cdf", "mix_source", "MIX_parts", "mix_cdf", "mix_copy", "id", "piece"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = mixing.replicate(docs, seed="t")
    assert got.columns == [*docs.drop("mix_copy").columns, "mix_rate", "mix_copies", "mix_copy", "mix_key"]
    got = got.collect()
    assert all(r.parts == r.cdf == r.mix_source == r.MIX_parts == "clash" for r in got)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t or "")
    rate = {s: 1 / 3 * sum(sizes.values()) / n if n else 0.0 for s, n in sizes.items()}
    assert rate["small"] > 3 * mixing.STEP
    want = Counter({i: c for i, _, s in rows if (c := inverse(rate[s], i, "t"))})
    assert Counter(r.doc_id for r in got) == want
    assert all(r.mix_copies == want[r.doc_id] for r in got) and len({(r.doc_id, r.mix_copy) for r in got}) == len(got)


def test_weights_and_mean(spark, make_docs):
    docs = make_docs([(i, "abcd", "a" if i % 4 else "b") for i in range(4000)])
    got = mixing.replicate(docs, {"a": 1.0, "b": 3.0}).groupBy("source").count().collect()
    share = {r.source: r["count"] for r in got}
    assert abs(share["a"] - 1000) < 150 and abs(share["b"] - 3000) < 250
    assert {r.source for r in mixing.replicate(docs, {"b": 1.0}).select("source").distinct().collect()} == {"b"}


def test_salted_join_gives_the_same(spark, make_docs, monkeypatch):
    docs = make_docs([(i, "abcd" * (i % 3), f"s{i % 5}" if i % 5 else None) for i in range(400)])
    key = lambda df: sorted((r.doc_id, r.mix_copy) for r in df.collect())
    want = key(mixing.replicate(docs))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert key(mixing.replicate(docs)) == want


def test_tiny_source_of_many_copies(spark, make_docs, monkeypatch):
    docs = make_docs([(i, "abcd" * 50, "large") for i in range(300)] + [(1000 + i, "a", "tiny") for i in range(2)] + [(2000, "word " * 50_000, "long")])
    key = lambda df: sorted((r.doc_id, r.mix_copy, r.mix_copies) for r in df.select("doc_id", "mix_copy", "mix_copies").collect())
    monkeypatch.setattr(mixing, "BURST", 10**9)
    want = key(mixing.replicate(docs))
    monkeypatch.setattr(mixing, "BURST", 64)
    assert key(mixing.replicate(docs)) == want and Counter(x[0] for x in want)[1000] > 10_000


def test_empty_and_repeated(spark, make_docs):
    assert mixing.replicate(make_docs([])).count() == 0
    got = mixing.replicate(make_docs([(1, "abc"), (1, "abc"), (2, "abc")])).collect()
    n = Counter(r.doc_id for r in got)
    assert n[1] % 2 == 0


def test_sql_is_native(spark, make_docs):
    plan = mixing.replicate(make_docs([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert duckdb.sql("select ('0x' || 'ff')::BIGINT").fetchall() == [(255,)]
