import math
import random
from collections import Counter

import corpus_pipeline as op
import pytest
from pyspark.sql import functions as F
from skylocus.llm import mixing, order_minhash, quality

GOOD, BAD = "the quiet river runs along old stone walls and {} returns to the sea", "$$$ !!! ### {} $$$ $$$ !!! ###"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with nulls, repeats, empty and very long texts, and labels, as a folder."""
    rng, sf = random.Random(2), str(tmp_path_factory.mktemp("sf"))
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    good = [" ".join(GOOD.format(word()) for _ in range(3)) + " " + " ".join(word() for _ in range(40)) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(good)]
    rows += [(100 + i, " ".join(BAD.format(word()) for _ in range(6))) for i in range(60)]
    rows += [(200 + i, good[i].upper()) for i in range(20)]  # exact copies
    rows += [(300 + i, good[i] + " once more") for i in range(30, 50)]  # near copies
    rows += [(500, None), (501, ""), (7, good[60] + " under an id that is taken"), (3, good[3]), (None, good[5]), (None, "a text without id, " + good[70][::-1])]
    rows += [(600, "long " + " ".join(word() for _ in range(60_000)))]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", f"s{len(t or '') % 3}", len(t or "")) for i, t in rows], kind)
    docs.withColumn("row_number", F.lit("clash")).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(60), *range(100, 150)]], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_each_stage_against_brute_force(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    first = dict(op.STAGES)

    good = first["quality"](spark, docs, corpus).cache()
    model = quality.train(docs, quality.grades(spark.read.parquet(f"{corpus}/labels.parquet")))
    above = list(model.grades).index(2) if 1 not in model.grades else list(model.grades).index(1)
    keeps = lambda t: model.tails(__import__("numpy").array([model.score(t or "")]))[0, above - 1] >= 0.5
    want = Counter({k: n for k, n in rows_of(docs).items() if keeps(k[1])})
    assert rows_of(good) == want and sum(1 for (i, _) in want if i is not None and i < 80) > 75
    assert not [i for (i, _) in want if i is not None and 100 <= i < 160]

    single = first["exact_dedup"](spark, good, corpus).cache()
    best = {}
    for i, t in want:
        low = (t or "").lower()
        if low not in best or (i is not None and (best[low] is None or i > best[low])):
            best[low] = i
    assert Counter((i, (t or "").lower()) for i, t in rows_of(single).elements()) == Counter((i, low) for low, i in best.items())

    apart = first["near_dedup"](spark, single, corpus).cache()
    rows = sorted(rows_of(single).elements(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    words = [(t or "").lower().split() for _, t in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for k, x in enumerate(words):
        for j in range(k):
            if min(len(x), len(words[j])) >= 0.8 * max(len(x), len(words[j])) and order_minhash.alike(x, words[j]):
                a, b = sorted((root(k), root(j)))
                up[b] = a
    assert rows_of(apart) == Counter(r for k, r in enumerate(rows) if root(k) == k)

    mixed = first["mixing"](spark, apart, corpus).cache()
    sizes = Counter()
    for r in apart.collect():
        sizes[r.source] += len((r.text or "").encode())
    total, want = sum(sizes.values()), Counter()
    for r in apart.collect():
        rate = total / sum(1 for n in sizes.values() if n) / sizes[r.source] if sizes[r.source] else 0.0
        want[r.doc_id, r.text] += inverse(rate, "" if r.doc_id is None else r.doc_id)
    assert rows_of(mixed) == +want
    for stage in (good, single, apart, mixed):
        assert stage.columns == docs.columns
    assert first["bpe"](spark, mixed, corpus).count() == mixed.count()


def inverse(rate, doc, seed="mix-1"):
    import hashlib

    parts, total = max(1, math.ceil(rate / mixing.STEP)), 0
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


def test_run_and_empty_table(spark, corpus, tmp_path):
    got = op.run(spark, corpus)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 60
    for name in ("documents", "labels"):
        spark.read.parquet(f"{corpus}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert op.run(spark, str(tmp_path)).count() == 0
