import hashlib
import random

import pytest
from pyspark.sql import functions as F
from skylocus.llm import bpe
from skylocus.llm.queries import tokenizer_path

ODD = [
    "", " ", "Hello, World!", "don't we'll I'VE 'so ''s", "a" * 500, "thhaherbletion" * 40, "é é ÀÉÎ", "ΣΊΣΥΦΟΣ ΟΔΟΣ", "İstanbul",
    "1234 ٣٤ Ⅷ ½", "x y z　w", "a\x1cb\x1fc\x0bd", "<|endoftext|>", "a<|startoftext|>B <|endoftext|>c<|endoftext", "日本語 テキスト", "😀😀 🏳️‍🌈", "\n\t tabs\r\n",
    "snake_case __init__ a_b", "…—“quotes”", "ſ ß ẞ ﬁ", "́ͅ", "क्षि", "|| *** $$$%%%", "\x00\x01", "Å Å",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_path())
    found.no_truncation()
    found.no_padding()
    return found


def test_codec_equals_library(library):
    own, rng = bpe.Codec(tokenizer_path()), random.Random(3)
    letters = "abcdefgh 'é.,Σs0 \n<|>tĹ日"
    for text in ODD + ["".join(rng.choices(letters, k=rng.randrange(80))) for _ in range(600)]:
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == want, repr(text)
        assert own.decode(want) == library.decode(want, skip_special_tokens=False), repr(text)


def test_query_rows(spark, make_docs, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(900, None), (901, "again"), (901, "again")]
    docs = make_docs(rows).withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("clash"))
    got = sorted(bpe.encode(docs, tokenizer_path()).collect())
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert [tuple(r) for r in got] == sorted(want)


def test_with_ids_and_empty(spark, make_docs):
    got = bpe.encode(make_docs([(1, "Hello you"), (2, None)]), tokenizer_path(), with_ids=True).orderBy("doc_id").collect()
    assert got[0].n_tokens == len(got[0].ids) and got[1].ids == [] and got[1].decoded == ""
    assert bpe.encode(make_docs([]), tokenizer_path()).count() == 0


def test_cache_bound(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    own, fresh = bpe.Codec(tokenizer_path()), bpe.Codec(tokenizer_path())
    for text in ["a b c d e f g", "g f e d c b a", "a " * 20, "a b"]:
        assert own.encode(text).tolist() == [i for w in text.split() for i in fresh.encode(w).tolist()]
        assert len(own.young) <= 3


def test_batch_equals_single_texts(library):
    own = bpe.Codec(tokenizer_path())
    ids, count = own.batch(ODD)
    assert count.tolist() == [len(own.encode(t)) for t in ODD]
    assert ids.tolist() == [i for t in ODD for i in own.encode(t).tolist()]
    assert own.batch([])[0].tolist() == []


def test_very_long_texts(spark, make_docs, library):
    long = "onha tithe " * 200_000
    rows = [(1, long), (2, "x" * 20_000)]
    got = {r.doc_id: r for r in bpe.encode(make_docs(rows), tokenizer_path()).collect()}
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_query_equals_library_on_all_documents(spark, library):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in bpe.encode(spark.read.parquet(f"{sf}/documents.parquet"), tokenizer_path()).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].decoded_sha256) == (len(ids), hashlib.sha256(said.encode()).hexdigest())
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_a_worker_forgets_its_pieces_when_it_turns_to_another_operator():
    import pyarrow as pa
    from skylocus.llm import order_minhash
    from skylocus.llm.common import tidy

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words to keep"])], names=["id", "text"])
    first = next(tidy(bpe._each(tokenizer_path(), True))(iter([batch])))
    again = list(tidy(bpe._each(tokenizer_path(), True))(iter([batch])))
    assert bpe.codec.cache_info().currsize == 1 and bpe.codec(tokenizer_path()).young  # kept from task to task
    list(tidy(order_minhash._sketched)(iter([batch])))
    assert bpe.codec.cache_info().currsize == 0
    assert next(tidy(bpe._each(tokenizer_path(), True))(iter([batch]))).equals(first) and again[0].equals(first)
