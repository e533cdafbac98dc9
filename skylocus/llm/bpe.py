"""Byte-pair encoding and decoding with a public word vocabulary.

A word's symbols form a doubly linked list; a heap holds the ranks of adjacent pairs that can merge.
The lowest rank leaves first, the leftmost among equals; an entry whose symbols have changed since is
stale and is skipped. Decoding joins the vocabulary's strings. The file is read once per worker from a
path that is a parameter; nothing is trained.

The texts of a batch are split together and each distinct piece is looked up once. A worker keeps two
generations of at most ``CACHE`` pieces until it turns to another operator; a piece longer than ``LONG``
characters is never kept.

Cases: null text is the empty text (no tokens); an empty table gives an empty result. A batch holds
``BYTES`` of text or one document, however long; merging takes O(n log n) in a piece's length. Repeated
rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, leaves, ranges, sliced, tidy

CACHE = 200_000
LONG = 64
#: Bytes of text encoded at once, or one document.
BYTES = 4 << 20

#: What the tokenizers library counts as white space, without that of ASCII.
_SPACE = regex.compile("[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_ASCII_SPACE = " \t\n\r\v\f"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    out = [""] * 256
    for b in plain:
        out[b] = chr(b)
    for k, b in enumerate(rest):
        out[b] = chr(256 + k)
    return out


class Codec:
    """Encoder and decoder of one tokenizer file (BPE with a word-end suffix, split by a pattern)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model = said["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.ranks: dict[tuple[int, int], int] = {}
        self.merges: list[tuple[int, int, int]] = []  # left, right and merged symbol of each rank
        for pair in model["merges"]:
            a, b = pair if not isinstance(pair, str) else pair.split(" ")
            self.ranks[vocab[a], vocab[b]] = len(self.merges)
            self.merges.append((vocab[a], vocab[b], vocab[a + b]))
        self.added = {x["content"]: x["id"] for x in said["added_tokens"]}
        self.strings = {v: k for k, v in vocab.items()} | {v: k for k, v in self.added.items()}
        pattern = next(x["pattern"]["Regex"] for x in said["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(pattern)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.inner, self.last = [vocab[c] for c in byte_alphabet()], [vocab[c + end] for c in byte_alphabet()]
        size = max(self.strings) + 1
        self.spelled = pa.array([self.strings.get(i, "") for i in range(size)])
        self.numbered = pa.array([str(i) for i in range(size)])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge adjacent symbols until no pair has a rank."""
        ranks, merges, n = self.ranks, self.merges, len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        # an entry is rank * n + place: the lowest rank leaves first, then the leftmost
        heap = [r * n + i for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = divmod(heapq.heappop(heap), n)
            a, b, both = merges[rank]
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue  # stale
            symbols[i], symbols[j] = both, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get((both, symbols[k]))) is not None:
                    heapq.heappush(heap, r * n + i)
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], both))) is not None:
                heapq.heappush(heap, r * n + h)
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> list[int]:
        raw, inner = word.encode(), self.inner
        symbols = [inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        return self.merge(symbols)

    def piece(self, piece: str) -> bytes:
        """Ids, 4 bytes each, of text without white space."""
        got = self.young.get(piece)
        if got is None:
            got = self.old.get(piece)
            if got is None:
                got = np.array([t for w in self.words.findall(piece) for t in self.word(w)], np.int32).tobytes()
            if len(piece) <= LONG:
                if len(self.young) >= CACHE:
                    self.old, self.young = self.young, {}
                self.young[piece] = got
        return got

    def ready(self, text: str) -> str:
        """Normalised text whose white space is that of ASCII, without any at its ends."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if _SPACE.search(text):
                text = _SPACE.sub(" ", text)
            # each character is lowered by itself, so a final sigma is as any other
            text = text.replace("Σ", "σ")
        return text.lower().strip(_ASCII_SPACE)

    def encode(self, text: str) -> np.ndarray:
        return self.batch([text])[0]

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, end to end, and the number of each text. A piece that several hold is looked up once."""
        parts, owner, special = [], [], []  # runs of plain text, and added tokens between them
        for k, text in enumerate(texts):
            split = self.special.split(text) if "<|" in text and self.special.search(text) else [text]
            for part in split:
                special.append(self.added.get(part, -1) if len(split) > 1 else -1)
                parts.append(self.ready(part) if special[-1] < 0 else "")
                owner.append(k)
        split = pc.ascii_split_whitespace(pa.array(parts, pa.string()))
        found = split.flatten().dictionary_encode()
        young, piece = self.young, self.piece
        known = []
        for p in found.dictionary.to_pylist():
            got = young.get(p)
            if got is None:
                got = piece(p)
                young = self.young
            known.append(got)
        held = np.frombuffer(b"".join(known), np.int32)
        size = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        index = found.indices.to_numpy()
        times = size[index]
        ids = held[ranges((np.cumsum(size) - size)[index], times)]
        count = np.diff(np.r_[0, np.cumsum(times)][split.offsets.to_numpy()])
        marks = np.array(special, np.int64)
        if (marks >= 0).any():
            ids = np.insert(ids, (np.cumsum(count) - count)[marks >= 0], marks[marks >= 0])
            count = count + (marks >= 0)
        return ids, np.bincount(np.array(owner, np.int64), count, len(texts)).astype(np.int64)

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.strings[i] for i in ids)


def joined(strings: pa.Array, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
    """The strings of each text's ids with one blank between them."""
    ends = pa.array(np.r_[0, np.cumsum(count)].astype(np.int32))
    said = pc.binary_join(pa.ListArray.from_arrays(ends, strings.take(pa.array(ids))), " ")
    return said.cast(pa.binary()).to_pylist()


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


leaves(__name__, codec.cache_clear)


def _each(path: str, ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = codec(path)
        for batch, raws in sliced(batches, BYTES):
            flat, count = found.batch([raw.decode("utf-8", "replace") for raw in raws])
            numbers, strings = joined(found.numbered, flat, count), joined(found.spelled, flat, count)
            arrays = [pa.array(count), *(pa.array([hashlib.sha256(x).hexdigest() for x in said], pa.string()) for said in (numbers, strings))]
            if ids:
                ends = pa.array(np.r_[0, np.cumsum(count)].astype(np.int32))
                arrays += [pa.ListArray.from_arrays(ends, pa.array(flat.astype(np.int32))), pa.array(strings, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 1 + len(arrays)])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: its id, n_tokens, ids_sha256, decoded_sha256; also ids and decoded if asked for.

    A narrow map: no shuffle, and a document never leaves its task.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    more = ", ids array<int>, decoded string" if with_ids else ""
    return rows.mapInArrow(tidy(_each(path, with_ids)), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}").withColumnRenamed("id", id_col)
