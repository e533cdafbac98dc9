import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from skylocus.llm import components as cc
from skylocus.llm import order_minhash as op
from skylocus.llm.common import table
from skylocus.llm.components import components


def hashed(words):
    return op.hashes("".join(w + " " for w in words).encode())


def buckets_of(words):
    return set(op.buckets(hashed(words), np.array([len(words)]))[0].tolist())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edits_equal_the_full_table():
    rng = random.Random(8)
    for _ in range(400):
        a = [rng.randrange(4) for _ in range(rng.randrange(30))]
        b = list(a) if rng.random() < 0.7 else [rng.randrange(4) for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = [rng.randrange(4) for _ in range(rng.randrange(2))]
        want, most = distance(a, b), rng.randrange(8)
        assert op.edits(a, b, most) == (want if want <= most else None), (a, b, most)


def test_long_slides():
    a = list(range(5000))
    b = a[:100] + [-1] + a[100:3000] + a[3001:]
    assert op.edits(a, b, 10) == 2 and op.edits(a, a, 0) == 0 and op.edits([], [], 0) == 0 and op.edits([], [1], 1) == 1


def groups_of(rows):
    found = defaultdict(set)
    for i, c in rows:
        found[c].add(i)
    return {frozenset(g) for g in found.values()}


def close(words):
    """All pairs by the definition."""
    ids, parent = sorted(words), {i: i for i in words}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = set()
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = words[i], words[j]
            n = max(len(a), len(b))
            if min(len(a), len(b)) >= op.LEAST * n and (a == b or op.alike(a, b)):
                links.add((i, j))
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return links, {i: root(i) for i in ids}


def test_classes_on_the_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    words = {r.doc_id: (r.text or "").lower().split() for r in docs.collect()}
    links, want = close(words)
    got = {r.doc_id: r.class_id for r in op.classes(docs).collect()}
    assert all(want[i] == want[c] for i, c in got.items())  # nothing joined that is apart
    lost = [(i, j) for i, j in links if got[i] != got[j]]
    assert len(lost) <= 0.02 * len(links)


def planted(rng, n):
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 200))] for _ in range(n)]
    rows, same = [], {}
    for k, words in enumerate(base):
        for c in range(rng.randrange(1, 6)):
            own = list(words)
            for _ in range(c and max(1, len(own) // 40)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(3000)}"
            same[len(rows)] = k
            rows.append((len(rows), " ".join(own)))
    return rows, same


def test_planted_copies(spark, make_docs):
    rows, same = planted(random.Random(3), 60)
    docs = make_docs(rows).withColumn("n", F.lit("clash")).withColumn("key", F.lit(0)).repartition(4)
    got = {r.doc_id: r for r in op.near_duplicates(docs).collect()}
    assert groups_of((i, r.class_id) for i, r in got.items()) == groups_of(same.items())
    assert sorted(i for i, r in got.items() if r.kept) == sorted({min(j for j in same if same[j] == k) for k in same.values()})
    kept = op.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 60


def test_one_hot_group_over_many_partitions(spark, make_docs):
    rng = random.Random(5)
    words = [f"w{rng.randrange(500)}" for _ in range(80)]
    rows = []
    for i in range(400):
        own = list(words)
        own[rng.randrange(80)] = f"y{i}"
        rows.append((i, " ".join(own)))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = op.classes(make_docs(rows)).select("class_id").distinct().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.class_id for r in got] == [0]


def test_cases(spark, make_docs):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (5, "One  TWO"), (6, long), (7, long + " more"), (8, "a a a a a a a"), (8, "a a a a a a a"), (None, "one two")]
    got = sorted(((r.doc_id, r.class_id) for r in op.classes(make_docs(rows)).collect()), key=repr)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6), (8, 8), (8, 8), (None, None)], key=repr)
    assert op.classes(make_docs([])).count() == 0


def test_repeated_ids_and_rows(spark, make_docs):
    """Unlike texts of one id are judged each by itself; of repeated rows one stays."""
    x, y, z = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    rows = [(1, x), (1, x), (1, y), (2, y + " more"), (2, z), (3, x + " more"), (None, z), (None, "alone"), (None, "alone")]
    docs = make_docs(rows).withColumn("row_number", F.lit("clash")).withColumn("class_id", F.lit(0)).withColumn("id", F.lit(1.5)).repartition(3)
    kept = op.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, x), (1, y), (2, z), (None, "alone")], key=repr)
    got = sorted(((r.doc_id, r.class_id) for r in op.classes(docs.where("doc_id is not null")).collect()))
    assert got == [(1, 1), (1, 1), (1, 1), (2, 1), (2, 2), (3, 1)]
    assert op.drop_near_duplicates(make_docs([])).count() == 0


def test_sketch_keeps_order():
    """The picked k-mers are hashed in text order, so that order counts."""
    h, n = hashed("a b c d e f g h i j k l".split()), np.array([12])
    assert len(op.kmers(h, n)[0]) == 8 and op.sketches(h, n).shape == (1, op.SKETCHES)
    assert not np.array_equal(op.sketches(h, n), op.sketches(h[::-1].copy(), n))
    twice = op.labelled(np.array([5, 5, 7, 5, 5], np.uint64), np.array([4, 1]))
    assert len(set(twice.tolist())) == 4 and twice[0] == twice[4]


def plain_buckets(h):
    """The buckets of one text, from the definition."""
    top = 2**64
    mix = lambda x: int(op._mix(np.array([x % top], np.uint64))[0])

    def runs(k):
        out = []
        for i in range(max(1, len(h) - k + 1)):
            x = 0
            for j, w in enumerate(h[i : i + k]):
                x = mix(x + int(w) + j + 1)
            out.append(x)
        seen = Counter()
        named = []
        for x in out:
            named.append(mix(x + seen[x] * 0x9E3779B97F4A7C15))
            seen[x] += 1
        return out, named

    def picked(named, j, pick):
        order = sorted(range(len(named)), key=lambda i: ((named[i] >> 32) * int(op._ODD[j]) % 2**32, i))
        return sorted(order[:pick])

    found = set()
    for j in range(op.SKETCHES):
        x, named = runs(op.K)
        b = int(op.SEEDS[j])
        for i in picked(named, j, op.PICK):
            b = mix(b + x[i])
        found.add(b)
        for k, fits in ((3, op.MIDDLE[0] <= len(h) <= op.MIDDLE[1]), (4, len(h) >= op.LEAST * op.MIDDLE[1])):
            if fits:
                _, named = runs(k)
                found.add(mix(named[picked(named, j, 1)[0]] + int(op.SEEDS[j]) + k))
    if op.SHORT[0] <= len(h) <= op.SHORT[1]:
        found |= {x % top for x in op.shortened(h).tolist()}
    return found


def test_buckets_by_the_definition(monkeypatch):
    rng = random.Random(4)
    texts = [[rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(n)] for n in (0, 1, 3, 4, 5, 6, 13, 14, 15, 0, 23, 24, 25, 30, 31, 80)]
    h, count = hashed([w for t in texts for w in t]), np.array([len(t) for t in texts])
    ends = np.cumsum(count)
    for got, b, n in zip(op.buckets(h, count), ends, count):
        assert {x % 2**64 for x in got.tolist()} == (plain_buckets(h[b - n : b]) if n else set())
    monkeypatch.setattr(op, "PART", 7)  # words over several parts, and longer than one
    long = [*(w for t in texts for w in t), "x" * 50, "y"]
    assert np.array_equal(hashed(long)[:-2], h) and len(set(hashed(["x" * 50, "y", "x" * 49, "x" * 50, ""]).tolist())) == 4


def test_components(spark, monkeypatch):
    rng = random.Random(9)
    chain = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(200, 300 + i) for i in range(50)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in chain:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    want = {i: root(i) for i in parent if root(i) != i}
    assert got == want
    for few in (20, 100):  # more edges than one task settles: dealt out, or by rounds of joins
        monkeypatch.setattr(cc, "ENOUGH", few)
        edges = spark.createDataFrame(chain, "a long, b long").repartition(5)
        assert {r.node: r.label for r in components(edges).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def edited(rng, words, share):
    """``words`` with ``share`` of them substituted, inserted or deleted."""
    own = list(words)
    for _ in range(round(share * len(words))):
        k, kind = rng.randrange(len(own)), rng.randrange(3)
        own[k : k + (kind != 1)] = [] if kind == 2 else [f"e{rng.randrange(10**6)}"]
    return own


def test_copies_alike_their_original_only(spark, make_docs):
    """No pair of a bucket is left out: each copy that shares a bucket with the original and is alike is in its class."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    texts = [words] + [edited(rng, words, 0.15) for _ in range(399)]
    sketches = [buckets_of(t) for t in texts]
    got = {r.doc_id: r.class_id for r in op.classes(make_docs([(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    met = [i for i in range(1, 400) if sketches[0] & sketches[i] and op.alike(" ".join(words), " ".join(texts[i]))]
    assert len(met) > 200 and [i for i in met if got[i] != 0] == []


def test_folded_counts_and_neighbours_never_cut():
    rng = random.Random(12)
    for _ in range(300):
        a = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(5, 60))]
        b = edited(rng, a, rng.random() * 0.5) or ["x"]
        x, y = (np.frombuffer(op.folded(hashed(t)), np.uint8).astype(int) for t in (a, b))
        assert max(np.maximum(x - y, 0).sum(), np.maximum(y - x, 0).sum()) <= distance(a, b)
        n = max(len(a), len(b))
        assert op.alike(a, b) == (distance(a, b) <= int(0.2 * n + 1e-9))


def test_rest_in_many_blocks(spark, make_docs, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 16)
    test_copies_alike_their_original_only(spark, make_docs)


def share_that_meets(n, edits, tries=200):
    """Share of alike pairs, ``n`` words with ``edits`` substitutions, insertions or deletions, that have a bucket in common."""
    rng, pairs = random.Random(n), []
    while len(pairs) < tries:
        a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        b = list(a)
        for _ in range(edits):
            k, kind = rng.randrange(len(b)), rng.randrange(3)
            b[k : k + (kind != 1)] = [] if kind == 2 else [f"e{rng.randrange(10**6)}"]
        if op.alike(a, b):
            pairs += [a, b]
    found = [set(x.tolist()) for x in op.buckets(hashed([w for t in pairs for w in t]), np.array([len(t) for t in pairs]))]
    return sum(bool(x & y) for x, y in zip(found[::2], found[1::2])) / (tries // 2)


def test_pairs_at_the_least_similarity_meet():
    assert all(share_that_meets(n, n // 5) == 1 for n in range(5, 15))
    assert all(share_that_meets(n, n // 5) >= 0.97 for n in (15, 16, 20, 25, 30, 31, 50, 200, 500))


def test_few_and_many_members_are_compared_alike():
    """Both ways find the same pairs in the same blocks."""
    import pyarrow as pa

    rng, rows = random.Random(6), []
    for group in range(12):
        words = [f"w{rng.randrange(30)}" for _ in range(40)]
        for _ in range(rng.randrange(2, 20)):
            t = edited(rng, words, rng.random() * 0.4) or ["x"]
            rows.append((group, group % 3, 0, group % 2, rng.randrange(2) if group % 2 else 0, len(rows), len(t), rng.randrange(4), rng.random() < 0.7, op.folded(hashed(t)), sorted(buckets_of(t) | {group})))
    names = ["bucket", "band", "low", "high", "salt", "id", "n", "class", "own", "folds", "sketch"]
    t = pa.table({c: pa.array(x, pa.binary() if c == "folds" else None) for c, x in zip(names, zip(*rows))})
    for nearest in (True, False):
        for group in range(12):
            part = t.filter(pa.compute.equal(t.column("bucket"), group)).combine_chunks()
            want = set(zip(*(x.tolist() for x in op._block(part, nearest))))
            got = set(zip(*(x.tolist() for x in op._small(part, np.array([0]), np.array([len(part)]), nearest))))
            assert got == want


def test_counts_of_two_words_never_cut():
    rng = random.Random(13)
    for _ in range(300):
        a = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(5, 70))]
        b = edited(rng, a, rng.random() * 0.5) or ["x"]
        x, y = (np.frombuffer(op.doubled(hashed(t)), np.uint8) for t in (a, b))
        assert 2 * len(a) < len(x) <= 4 * len(a) and op.difference(x, y) == op.difference(y, x) <= 4 * distance(a, b)
    x, y = (np.frombuffer(op.doubled(hashed(t)), np.uint8) for t in ([], ["a"]))
    assert op.difference(x, y) <= 4


def test_texts_that_cannot_be_alike_are_not_fetched(spark, make_docs, monkeypatch):
    """Texts of the same words in another order share a passage, so buckets; before, all were written and sent once for each pair."""
    rng = random.Random(14)
    passage, words = [f"p{i}" for i in range(50)], [f"w{i}" for i in range(150)]
    texts = [passage + rng.sample(words, len(words)) for _ in range(40)]
    texts.append([*texts[7][:-10], *(f"n{i}" for i in range(10))])
    assert sum(bool(buckets_of(texts[0]) & buckets_of(t)) for t in texts) > 30
    held, cut = [], op.cut

    def counted(df, name):
        out = cut(df, name)
        held.extend([out.count()] if name == "omh-held" else [])
        return out

    monkeypatch.setattr(op, "cut", counted)
    for groups in (1, 7):
        held.clear()
        monkeypatch.setattr(op, "GROUPS", groups, raising=False)
        got = {r.doc_id: r.class_id for r in op.classes(make_docs([(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
        assert got == {i: 7 if i == 40 else i for i in range(41)}
        assert held and sum(held) == 2


def test_strips_change_nothing(monkeypatch):
    for strip, wide in ((1, 2048), (4, 3)):
        monkeypatch.setattr(op, "STRIP", strip)
        monkeypatch.setattr(op, "WIDE", wide)
        test_few_and_many_members_are_compared_alike()


def test_hashes_of_words_never_cut():
    import pyarrow as pa

    rng = random.Random(15)
    said = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(5, 70))] for _ in range(60)]
    said += [edited(rng, said[i % 60], rng.random() * 0.4) or ["x"] for i in range(240)]
    held = pa.table({"node": range(300), "said": pa.array([hashed(t).astype(np.uint32).tobytes() for t in said], pa.binary())})
    pairs = [(i % 60, i) for i in range(60, 300)] + [(0, i) for i in range(1, 60)]
    alike = {(a, b) for a, b in pairs if op.alike(said[a], said[b])}
    assert 30 < len(alike) < 210
    for aligned in (False, True):
        got = op._near_doubled(pa.table({"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}), held, aligned)
        got = set(zip(got.column("a").to_pylist(), got.column("b").to_pylist()))
        assert got == alike if aligned else got >= alike


def test_a_long_common_passage_is_not_fetched_for_each_pair(spark, make_docs, monkeypatch):
    """Texts that share too little beside a passage, or its parts in another order; before, all were fetched and aligned as texts."""
    rng = random.Random(16)
    passage, blocks = [f"p{i}" for i in range(120)], [[f"b{i}-{j}" for j in range(15)] for i in range(10)]
    own = [passage + [f"o{rng.randrange(10**6)}" for _ in range(45)] for _ in range(40)]
    moved = [sum(rng.sample(blocks, 10), []) for _ in range(40)]
    held, cut = [], op.cut

    def counted(df, name):
        out = cut(df, name)
        held.extend([out.count()] if name == "omh-held" else [])
        return out

    monkeypatch.setattr(op, "cut", counted)
    for texts, whole in ((own, True), (moved, False)):
        held.clear()
        got = {r.doc_id: r.class_id for r in op.classes(make_docs([(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
        assert got == {i: i for i in range(40)}
        assert held[-1] == 0 and not (whole and sum(held))


def test_counters_by_length_never_cut():
    rng = random.Random(17)
    for size in (20, 300, 1500):
        for _ in range(20):
            a = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(size // 2, size))]
            b = edited(rng, a, rng.random() * 0.4) or ["x"]
            x, y = (np.frombuffer(op.widened(hashed(t)), np.uint16) for t in (a, b))
            assert op.apart(x, len(a), y, len(b)) == op.apart(y, len(b), x, len(a)) <= (Counter(a) | Counter(b)).total() - (Counter(a) & Counter(b)).total()
            assert op.apart(x, len(a), y, len(b)) <= max(len(a), len(b)) - (Counter(a) & Counter(b)).total()
    a, b = ["a"] * 70_000, ["a"] * 140_000 + ["b"] * 9
    x, y = (np.frombuffer(op.widened(hashed(t)), np.uint16) for t in (a, b))
    assert op.apart(x, len(a), x, len(a)) <= 0 and op.apart(x, len(a), y, len(b)) <= len(b) - len(a)


def test_limited_counts_are_folded_as_if_counted_so():
    """Two words of one counter, 200 times each: 400 in the longer text's two counters, 255 in the shorter's one; before, that was a difference of 145."""
    assert op.difference(np.array([200, 1, 200, 0], np.uint8), np.array([255, 1], np.uint8)) == 0


def long_texts(rng):
    """A common passage and words of one vocabulary: ``FOLDS`` counters cannot tell them apart, two of them are alike."""
    passage = [f"p{i}" for i in range(500)]
    texts = [passage + [f"w{rng.randrange(4000)}" for _ in range(2000)] for _ in range(16)]
    return [*texts, [*texts[3][:-100], *(f"n{i}" for i in range(100))]]


def test_long_texts_are_told_apart_before_their_hashes_are_sent(spark, make_docs, monkeypatch):
    """Before, the hashes of all such texts of later rounds were sent to each pair of groups: they grew with the square of the texts."""
    asked, near_doubled = [], op._Texts.near_doubled

    def counted(self, pairs, aligned):
        asked.append(pairs.count())
        return near_doubled(self, pairs, aligned)

    monkeypatch.setattr(op._Texts, "near_doubled", counted)
    texts = long_texts(random.Random(18))
    got = {r.doc_id: r.class_id for r in op.classes(make_docs([(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    assert got == {i: 3 if i == 16 else i for i in range(17)}
    assert len(asked) > 1 and sum(asked[1:]) == 0


def test_passes_change_nothing(spark, make_docs, monkeypatch):
    """What is sent is bounded by passes; before, one pass sent it all."""
    names, cut = Counter(), op.cut

    def counted(df, name):
        names[name] += 1
        return cut(df, name)

    monkeypatch.setattr(op, "cut", counted)
    rng = random.Random(19)
    texts = [t[:700] for t in long_texts(rng)]
    texts += [edited(rng, texts[i], 0.15) for i in range(4)]
    docs, found = make_docs([(i, " ".join(t)) for i, t in enumerate(texts)]), []
    for least in (1 << 28, 80_000):
        names.clear()
        monkeypatch.setattr(op, "SENT", 0)
        monkeypatch.setattr(op, "SENT_BYTES", least)
        found.append(sorted(map(tuple, op.classes(docs).collect())))
        assert (names["omh-doubled"] > names["omh-links"]) == (names["omh-met"] > names["omh-rest"]) == (least == 80_000)
    assert found[0] == found[1]
