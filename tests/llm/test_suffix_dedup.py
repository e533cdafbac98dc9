import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from skylocus.llm import suffix_dedup as op


def brute(rows):
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, t in data:
        for k in range(len(t) - op.WIDTH + 1):
            w = t[k : k + op.WIDTH]
            first[w] = min(first.get(w, op.LAST), op.LAST if i is None else i)
    out = []
    for i, t in data:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - op.WIDTH + 1):
            if first[t[k : k + op.WIDTH]] < (op.LAST if i is None else i):
                gone[k : k + op.WIDTH] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(docs, **options):
    return sorted((tuple(r)[:5] for r in op.repeated(docs, **options).collect()), key=repr)


def test_suffix_array_sorts_every_string():
    rng = random.Random(1)
    parts = [[rng.randrange(1, a + 1) for _ in range(rng.randrange(0, 60))] + [0] for a in (1, 2, 3, 20) for _ in range(60)]
    bounds = np.r_[0, np.cumsum([len(p) for p in parts])]
    got = op.suffix_array(np.array(sum(parts, [])), bounds)
    for k, p in enumerate(parts):
        assert (got[bounds[k] : bounds[k + 1]] - bounds[k]).tolist() == sorted(range(len(p)), key=lambda i: p[i:])


def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 8))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [prose(30) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [prose(rng.randrange(0, 40)) for _ in range(3)]
        if rng.random() < 0.7:
            text = rng.choice(passages)
            cut = rng.randrange(0, 60)
            parts.insert(1, text[cut : cut + rng.randrange(40, 140)])
        rows.append((rng.randrange(0, 10_000), " ".join(parts)))
    edited = rows[3][1]
    rows += [(20_000 + k, edited[: 10 * k] + "#" + edited[10 * k :]) for k in range(12)]
    rows += [(5, "x" * 49), (6, "x" * 50), (7, "x" * 300), (8, "ab" * 90), (9, "ab" * 40), (11, None), (12, ""), (13, rows[0][1]), (13, rows[0][1]), (13, rows[1][1]), (None, rows[2][1]), (None, rows[2][1])]
    return rows + [(30_000 + k, rows[1][1]) for k in range(40)]


def test_rows_match_brute_force(spark, make_docs):
    rows = corpus()
    docs = make_docs(rows).withColumn("id", F.lit("clash")).withColumn("code", F.lit(1)).repartition(5)
    assert run(docs) == brute(rows)


def test_refiled_groups_match_brute_force(spark, make_docs):
    rows = corpus()
    assert run(make_docs(rows), group_texts=2) == brute(rows)


def test_a_hash_may_collide(spark, make_docs, monkeypatch):
    """Groups of unlike anchors only cost time."""
    texts = ["a" * 20 + "b" * 40 + str(k) * 60 for k in range(5)]
    rows = [(7, t.encode(), i, i) for i, t in enumerate(texts)]
    owners = {r["piece"]: r["runs"] for r in op.decide(rows).to_pylist()}
    assert owners[texts[4].encode()][0] == {"first": 0, "last": 10, "low": 0}


def test_empty(spark, make_docs):
    assert run(make_docs([])) == []
    assert run(make_docs([(1, None), (2, "short")])) == brute([(1, None), (2, "short")])


def test_codes_meet_across_batches():
    import itertools

    import pyarrow as pa

    rng = random.Random(2)
    rows = sorted((rng.randrange(40), 2 * chunk + (rng.random() < 0.05)) for chunk in range(60))
    want = sorted((t >> 1, c) for c, g in itertools.groupby(rows, key=lambda r: r[0]) for g in [list(g)] for _, t in g if len(g) > 1 or t & 1)
    for size in (1, 2, 3, 60):
        batches = [pa.RecordBatch.from_pydict({"code": [r[0] for r in rows[k : k + size]], "tag": [r[1] for r in rows[k : k + size]]}) for k in range(0, len(rows), size)]
        got = [(r["chunk"], r["code"]) for b in op._meet(iter(batches)) for r in b.to_pylist()]
        assert sorted(got) == want


def test_the_first_sort_is_by_keys_of_16_bits(monkeypatch):
    rng, keys, sort = np.random.default_rng(4), [], np.lexsort
    monkeypatch.setattr(op.np, "lexsort", lambda k: keys.append([x.dtype for x in k]) or sort(k))
    for top, kind in ((258, np.uint16), (1 << 20, np.int64)):  # larger symbols are sorted as they are
        parts = [np.r_[rng.integers(1, top, 40), 0] for _ in range(9)]
        parts[0][0] = top - 1
        keys.clear()
        got = op.suffix_array(np.concatenate(parts), np.arange(10) * 41)
        assert keys[0] == [kind, np.uint16]
        assert got.tolist() == [41 * p + k for p, x in enumerate(parts) for k in sorted(range(41), key=lambda k: x[k:].tolist())]


def test_codes_tell_anchors_of_one_document_from_those_of_several():
    rng = random.Random(8)
    parts = ["".join(rng.choices("abcdefgh", k=400)).encode() for _ in range(3)]
    parts += [parts[0] + parts[0], parts[1][100:300], b"short"]
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([parts], pa.list_(pa.binary()))], names=["chunk", "texts"])
    out = pa.Table.from_batches(op._codes(iter([batch])))
    row, code, _, _ = op.anchors(parts)
    want = {c: 14 + (len(set(row[code == c])) > 1) for c in code.tolist()}
    assert dict(zip(out.column("code").to_pylist(), out.column("tag").to_pylist())) == want and len(out) == len(want)
    assert set(want.values()) == {14, 15}


def test_anchors_travel_many_in_a_row():
    """One row for each chunk and part instead of one for each anchor; what meets is the same."""
    rng = np.random.default_rng(8)
    words = [rng.integers(97, 123, 60).astype(np.uint8).tobytes() for _ in range(30)]
    chunks = [[b"".join(words[k] for k in rng.integers(0, 30, 12)) for _ in range(3)] for _ in range(6)]
    batches = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([c], pa.list_(pa.binary()))], names=["chunk", "texts"]) for k, c in enumerate(chunks)]
    plain = pa.Table.from_batches(list(op._codes(iter(batches)))).sort_by("code").combine_chunks()
    want = sorted((r["chunk"], r["code"]) for b in op._meet(iter(plain.to_batches())) for r in b.to_pylist())
    for parts in (1, 7, 65535):
        rows = pa.Table.from_batches(list(op._packed(iter(batches), parts))).sort_by("part").combine_chunks()
        assert rows.num_rows <= 6 * min(parts, plain.num_rows)
        got = sorted((r["chunk"], r["code"]) for b in op._unpacked(iter(rows.to_batches(max_chunksize=5))) for r in b.to_pylist())
        assert got == want and len(want) > 100
    alone = op.decide([(5, b"x" * 60, 1, 1), (6, b"y" * 70, 1, 2)]).to_pylist()
    assert [r["runs"] for r in alone] == [[], [{"first": 0, "last": 20, "low": 1}]]
