import hashlib
from collections import defaultdict

from pyspark.sql import functions as F
from skylocus.llm import exact_dedup as op


def brute(rows):
    groups = defaultdict(list)
    low = lambda t: (t or "").encode().lower()
    for i, t in rows:
        groups[low(t)].append(i)
    out = []
    for i, t in rows:
        own = groups[low(t)]
        top = max((x for x in own if x is not None), default=None)
        out.append((i, top, len(own), i is not None and i == top, hashlib.sha256(low(t)).hexdigest()))
    return sorted(out, key=repr)


def test_rows_match_brute_force(spark, make_docs):
    rows = [(1, "Same"), (2, "sAME"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x" * 300_000), (8, "X" * 300_000), (9, "alone"), (10, "twice"), (10, "twice"), (None, "Same"), (None, "no id")]
    rows += [(100 + i, "copy") for i in range(500)]
    docs = make_docs(rows).withColumn("id", F.lit("clash")).withColumn("digest", F.lit(1)).repartition(5)
    got = op.exact_duplicates(docs).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_empty(spark, make_docs):
    assert op.exact_duplicates(make_docs([])).count() == 0
    assert op.drop_duplicates(make_docs([])).count() == 0


def test_grace_spills_and_recurses():
    records = [(hashlib.sha256(x).digest(), x, i, 1, 1) for i in range(3) for x in (b"%d" % k * 50 for k in range(400))]
    got = sorted(op.grace(iter(records), memory=4000, fanout=3))
    assert [(c, top, n, t) for _, c, top, n, t in got] == [(c, 2, 3, 1) for _, c in sorted({r[:2] for r in records})]


def test_equal_digests_of_different_content_stay_apart():
    same = b"\0" * 32
    got = sorted(op.grace(iter([(same, b"a", 1, 1, 1), (same, b"b", 2, 1, 1), (same, b"a", 3, 1, 1), (same, b"a", 3, 1, 1)]), memory=1, fanout=2))
    assert got == [(same, b"a", 3, 3, 2), (same, b"b", 2, 1, 1)]


def test_drop_keeps_one_of_each(spark, make_docs):
    docs = make_docs([(1, "a"), (2, "A"), (3, "b"), (4, None), (5, "")])
    kept = op.drop_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5]


def test_drop_decides_by_row(spark, make_docs):
    """No text is lost with a twin of its id, and of repeated rows one stays."""
    rows = [(1, "a"), (1, "b"), (2, "A"), (3, "same"), (3, "same"), (4, "c"), (4, "SAME"), (None, "A"), (None, "x"), (None, "X"), (None, None), (5, "")]
    docs = make_docs(rows).withColumn("row_number", F.lit("clash")).withColumn("digest", F.lit(1)).withColumn("id", F.lit("clash")).repartition(3)
    kept = op.drop_duplicates(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, (r.text or "").lower()) for r in kept.collect()), key=repr)
    assert got == sorted([(1, "b"), (2, "a"), (4, "c"), (4, "same"), (None, "x"), (5, "")], key=repr)
