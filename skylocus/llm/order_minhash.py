"""Near duplicates by order MinHash, verified by banded alignment.

Text is lower-cased and split into words; equal word sequences are one class from the start. Every
``K`` words in a row, labelled with the number of the occurrence, are hashed under each of ``SKETCHES``
seeds; the ``PICK`` smallest are kept in the order in which they stand in the text, and their hash is a
bucket. So two texts share a bucket with a probability that follows their edit similarity. Pairs near
``LEAST`` seldom share two k-mers of five words, so there are more buckets: the smallest run of four words
under each seed, of three in texts of 12 to 30 words; and texts of 5 to 14 words have as buckets what is left
of them without any one or two words, as many as ``LEAST`` allows to differ, which misses no pair of them.

Each bucket is walked in order of length, over as many tasks as it needs: a member is paired with the
member before it and with the bucket's leader, the first member that is not too short to be alike. So
the number of pairs is linear in that of buckets' members. A pair is a link if an alignment of words
inside a band of ``(1 - LEAST) * longer`` costs no more than that: similarity is 1 - edits / longer.
Of these the pair of most shared buckets of each text is verified. Classes are the components of the links.

Then the rest is done exactly: in each bucket that still holds several classes, all pairs of different
classes are compared, in groups of like lengths and blocks of members dealt by salt, by counts of words folded into ``FOLDS``, whose
common part is never less than that of the texts. Pairs within the bound are verified: first the nearest
of each class, whose links join most classes, then all that are still apart, each pair in the smallest
bucket of several classes that it shares. So no pair of a bucket stays unverified unless its ends are in one class already or
cannot be alike.

Before texts are fetched, pairs are judged by less: those of the walk by their folded counts of words, and
all by hashes of their words, held in groups of texts of bounded size, so that each text's hashes are sent once for each
pair of groups and not once for each pair: by counts of each two words in a row (``doubled``), by the words in common, and the last ones,
of which few are alike, by the alignment of the hashes. Pairs of the last two rounds, whose number grows faster than the texts,
are judged first by as many counters as their length asks for (``widened``), an eighth of the hashes. Where more would be sent than
``SENT`` of all texts' hashes, it is sent in several passes, each deleted once read. All of this only rules out what cannot be alike.

Cases: null text is empty; texts without words are one class; a text of fewer than ``K`` words is one
k-mer, and one with fewer k-mers than ``PICK`` keeps all; a worker holds ``PART`` bytes of texts or one text,
however long, and some ten times as much for its hashes. Rows that repeat an id each give a row, in the class of their own text. Rows without id are in no
class (null), but ``drop_near_duplicates`` treats them like others, as larger than every id. Other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import bound_batches, cut, forget_shuffles, fresh, ranges, release, sliced, texts, tidy
from .components import components

K, PICK, SKETCHES, LEAST = 5, 2, 24, 0.8
#: Words of texts that are also compared by what is left without some, and by runs of three; alike texts are both in one range, or of at least LEAST * MIDDLE[1] words.
SHORT, MIDDLE = (4, 14), (12, 30)
#: Ids of at most so many candidate texts (16 MB) are broadcast to pick out their texts.
BROADCAST_IDS = 2_000_000
#: Counters of words that bound the edits of a pair from below, and members of one block of a bucket.
FOLDS, BLOCK = 256, 4096
#: Counts of one counter that the first comparison of a block tells apart; what is above is bounded as a whole.
LEVELS = 6
#: Members of blocks that are compared many at once.
FEW = 24
#: Members of a block that are compared with the others at once.
STRIP = 128
#: Buckets compared at once.
WIDE = 2048
#: Bytes of words' hashes of one group of texts, and pairs of two groups, that a task compares; groups at least.
GROUP_BYTES, GROUP_PAIRS, GROUPS = 4 << 20, 1 << 19, 4
#: The same of counters (``widened``), of which a word makes less than a byte.
WIDE_BYTES = 16 << 20
#: Share of the bytes of all texts' hashes that is sent to groups or blocks in one pass, and bytes that always may be.
SENT, SENT_BYTES = 0.5, 256 << 20
#: Bytes of a member of a block, compressed as shuffles are.
MEMBER_BYTES = 160
#: Bytes of texts that a worker holds at once, or one text.
TEXT_BYTES = 4 << 20
#: Bytes of texts sketched at once, or one text.
PART = 1 << 20

_U = np.uint64
_C1, _C2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _seeds() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"sketch %d" % j) for j in range(SKETCHES)], _U)


SEEDS = _seeds()
_ODD = (SEEDS >> _U(32)).astype(np.uint32) | np.uint32(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _C1
    x = (x ^ (x >> _U(27))) * _C2
    return x ^ (x >> _U(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(10).integers(0, 1 << 63, 256, dtype=np.uint64)
_FORTH, _BACK = _powers(PART + 1, _BASE), _powers(PART + 1, pow(_BASE, -1, 1 << 64))


def hashes(said: bytes) -> np.ndarray:
    """A hash of each word of text in which each word ends in one blank: sums over its bytes of powers of their place, in parts of ``PART`` bytes."""
    data = np.frombuffer(said, np.uint8)
    ends = np.flatnonzero(data == 32)
    out, start, done = np.empty(len(ends), _U), 0, 0
    while done < len(ends):
        last = max(done + 1, int(np.searchsorted(ends, start + PART)))  # words that end in this part, one at least
        stop = int(ends[last - 1]) + 1
        n = stop - start
        forth, back = (_FORTH[:n], _BACK) if n <= PART else (_powers(n, _BASE), _powers(n, pow(_BASE, -1, 1 << 64)))
        total = np.r_[_U(0), np.cumsum(_BYTES[data[start:stop]] * forth)]
        upto = ends[done:last] - start
        first = np.r_[0, upto[:-1] + 1]
        out[done:last] = _mix((total[upto] - total[first]) * back[first] + (upto - first).astype(_U))
        start, done = stop, last
    return out


def kmers(h: np.ndarray, count: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of ``k`` words of each text, of all its words if they are fewer, and their number; ``count``: words of each text."""
    begin, many = np.cumsum(count) - count, np.maximum(count - k + 1, 0)
    run = np.zeros(max(0, len(h) - k + 1), _U)
    for j in range(k if len(run) else 0):
        run = _mix(run + h[j : j + len(run)] + _U(j + 1))
    few = np.flatnonzero((count > 0) & (count < k))
    number = many.copy()
    number[few] = 1
    out, at = np.zeros(number.sum(), _U), np.cumsum(number) - number
    out[ranges(at, many)] = run[ranges(begin, many)]
    for i in few:
        x = _U(0)
        for j in range(count[i]):
            x = _mix(x + h[begin[i] + j : begin[i] + j + 1] + _U(j + 1))[0]
        out[at[i]] = x
    return out, number


def labelled(x: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The same with the number of the occurrence in the text."""
    key = _mix(x + np.repeat(np.arange(len(number)), number).astype(_U) * _U(0xD1342543DE82EF95))
    order = np.argsort(key, kind="stable")
    s = key[order]
    again = np.flatnonzero(s[1:] == s[:-1]) + 1
    if not len(again):
        return _mix(x)
    start = np.ones(len(x), bool)
    start[again] = False
    at = np.arange(len(x))
    nth = np.empty(len(x), _U)
    nth[order] = (at - np.maximum.accumulate(np.where(start, at, 0))).astype(_U)
    return _mix(x + nth * _U(0x9E3779B97F4A7C15))


def _places(x: np.ndarray, number: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each seed its number, and of each text with k-mers the place of its smallest and of its second smallest, itself if there is none.

    A seed's order is that of the upper halves times an odd number of its own, the first of equals.
    """
    top, at = (x >> _U(32)).astype(np.uint32), np.arange(len(x), dtype=_U)
    starts = (np.cumsum(number) - number)[number > 0]
    single = number[number > 0] == 1
    for j in range(SKETCHES):
        y = ((top * _ODD[j]).astype(_U) << _U(32)) | at
        first = (np.minimum.reduceat(y, starts) & _U(0xFFFFFFFF)).astype(np.int64)
        y[first] = _U(0xFFFFFFFFFFFFFFFF)
        second = (np.minimum.reduceat(y, starts) & _U(0xFFFFFFFF)).astype(np.int64)
        yield j, first, np.where(single, first, second)


def sketches(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The bucket of each text (rows) and seed: its smallest labelled k-mers, in the order of the text. Texts without words have none that counts."""
    x, number = kmers(h, count)
    out = np.zeros((len(count), SKETCHES), _U)
    if len(x):
        for j, a, b in _places(labelled(x, number), number):
            early = _mix(SEEDS[j] + x[np.minimum(a, b)])
            out[number > 0, j] = np.where(a == b, early, _mix(early + x[np.maximum(a, b)]))
    return out.view(np.int64)


def smallest(h: np.ndarray, count: np.ndarray, k: int) -> np.ndarray:
    """The smallest labelled run of ``k`` words of each text under each seed, as a bucket."""
    x, number = kmers(h, count, k)
    x, out = labelled(x, number), np.zeros((len(count), SKETCHES), _U)
    if len(x):
        for j, a, _ in _places(x, number):
            out[number > 0, j] = _mix(x[a] + SEEDS[j] + _U(k))
    return out.view(np.int64)


def shortened(h: np.ndarray) -> np.ndarray:
    """A hash of the words, and of what is left without each choice of as many words as may differ."""
    n, most = len(h), math.floor((1 - LEAST) * len(h) + 1e-9)
    out = []
    for gone in range(most + 1):
        for drop in combinations(range(n), gone):
            out.append(xxhash.xxh3_64_intdigest(np.delete(h, drop).tobytes()))
    return np.unique(np.array(out, _U)).view(np.int64)


def buckets(h: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """All buckets of each text, ascending."""
    begin = np.cumsum(count) - count
    found: list[list[np.ndarray]] = [[row] if n else [] for row, n in zip(sketches(h, count), count)]
    for k, fits in ((3, (count >= MIDDLE[0]) & (count <= MIDDLE[1])), (4, count >= LEAST * MIDDLE[1])):
        which = np.flatnonzero(fits)
        for i, row in zip(which, smallest(h[ranges(begin[which], count[which])], count[which], k)):
            found[i].append(row)
    for i in np.flatnonzero((count >= SHORT[0]) & (count <= SHORT[1])):
        found[i].append(shortened(h[begin[i] : begin[i] + count[i]]))
    return [np.unique(np.concatenate(f)) if f else np.zeros(0, np.int64) for f in found]


def folded(h: np.ndarray) -> bytes:
    """Counts of words folded into ``FOLDS``, up to 255: neither folding nor the limit adds to a difference."""
    return np.minimum(np.bincount((h & _U(FOLDS - 1)).astype(np.int64), minlength=FOLDS), 255).astype(np.uint8).tobytes()


def doubled(h: np.ndarray) -> bytes:
    """Counts of each two words in a row, up to 255, folded into a power of two of counters: more than twice the words, at most four times.

    An edit adds and takes no more than two each, so two texts differ in the sum over all counters by four for each edit at most.
    """
    size = 2 << len(h).bit_length()
    run = _mix(_mix(h[:-1]) + h[1:])
    return np.minimum(np.bincount((run & _U(size - 1)).astype(np.int64), minlength=size), 255).astype(np.uint8).tobytes()


def _level(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counters of two texts, the longer ones folded to the length of the shorter and limited as these are."""
    if len(x) < len(y):
        x, y = y, x
    return np.minimum(x.reshape(-1, len(y)).sum(0, dtype=np.int64), np.iinfo(y.dtype).max), y


def difference(x: np.ndarray, y: np.ndarray) -> int:
    """Sum of the differences of two texts' counters of ``doubled``."""
    x, y = _level(x, y)
    return int(np.abs(x - y).sum())


def widened(h: np.ndarray) -> bytes:
    """Counts of words, up to 65535, folded into a power of two of counters: more than a quarter of the words, at most half, 64 at least."""
    size = 1 << max(6, (len(h) // 4).bit_length())
    return np.minimum(np.bincount((h & h.dtype.type(size - 1)).astype(np.int64), minlength=size), 65535).astype(np.uint16).tobytes()


def apart(x: np.ndarray, n: int, y: np.ndarray, m: int) -> int:
    """No more than the edits between two texts of ``n`` and ``m`` words, by their counters of ``widened``."""
    u, v = _level(x, y)
    shared = int(np.minimum(u, v).sum()) + min(max(n, m) - int(u.sum()), max(n, m) - int(v.sum()))  # counts above 65535
    return max(n, m) - shared


def _key(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join([*words, ""]).encode())


def _words(parts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of each text, each with one blank behind it, their number, and the hashes of all."""
    words = [raw.decode("utf-8", "replace").lower().split() for raw in parts]
    said = [" ".join([*w, ""]).encode() for w in words]
    count = np.array([len(w) for w in words], np.int64)
    del words
    return said, count, hashes(b"".join(said))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, parts in sliced(batches, PART):
        said, count, h = _words(parts)
        keys = [xxhash.xxh3_128_digest(x) for x in said]
        ends = np.cumsum(count)
        folds = [folded(h[b - n : b]) for b, n in zip(ends, count)]
        arrays = [pa.array(keys, pa.binary()), pa.array(count, pa.int32()), pa.array(buckets(h, count), pa.list_(pa.int64())), pa.array(folds, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names=["id", "key", "n", "sketch", "folds"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each bucket from rows in order; also, as rows of kind 1, a partition's first and last member, and of kind 2 the members of buckets of several."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int8()]
    names = ["a", "b", "bucket", "n", "kind"]

    def out(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, kinds)], names=names)

    first = last = None  # (bucket, n, id)
    lead = None  # (n, id) of the bucket of ``last``
    for batch in batches:
        bucket, n, ids = (batch.column(c).to_numpy() for c in ("bucket", "n", "id"))
        if not len(bucket):
            continue
        rows = []
        if first is None:
            first = (int(bucket[0]), int(n[0]), int(ids[0]))
        before = np.concatenate([[bucket[0] if last is None else last[0]], bucket[:-1]])
        same = bucket == before
        if last is None:
            same[0] = False
        shared = same | np.append(same[1:], False)
        members = [np.concatenate([[was], own[shared]]) if same[0] else own[shared] for own, was in zip((ids, bucket, n), (last[2], last[0], last[1]) if last else (0, 0, 0))]
        if len(members[0]):
            size = len(members[0])
            yield pa.RecordBatch.from_arrays([pa.array(members[0], pa.int64()), pa.nulls(size, pa.int64()), pa.array(members[1], pa.int64()), pa.array(members[2], pa.int32()), pa.array(np.full(size, 2, np.int8))], names=names)
        for i in np.flatnonzero(same):
            b, size, own = int(bucket[i]), int(n[i]), int(ids[i])
            was_n, was = (int(n[i - 1]), int(ids[i - 1])) if i else (last[1], last[2])
            if i == 0 or not same[i - 1]:
                lead = lead if i == 0 and lead else (was_n, was)
            if was_n >= LEAST * size and was != own:
                rows.append((min(was, own), max(was, own), b, size, 0))
            if lead[0] < LEAST * size:
                lead = (size, own)
            elif lead[1] not in (was, own):
                rows.append((min(lead[1], own), max(lead[1], own), b, size, 0))
        if not same[-1]:
            lead = None
        last = (int(bucket[-1]), int(n[-1]), int(ids[-1]))
        yield out(rows)
    if first is not None:
        yield out([(x[2], None, x[0], x[1], 1) for x in (first, last)])


def _common(folds: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row per text whose product with another's, plus the lesser of their rests, is no less than the words in common."""
    steps = (folds[:, None, :] >= np.arange(1, LEVELS + 1, dtype=np.uint8)[None, :, None]).reshape(len(folds), -1)
    every = steps.all(0)  # what all have needs no product
    rest = n - np.minimum(folds, LEVELS).sum(1, dtype=np.int64) + every.sum()
    return steps[:, steps.any(0) & ~every].astype(np.float32), rest.astype(np.float32)


class _Earlier:
    """Whether members share a bucket smaller than this one."""

    def __init__(self, sketches: list[np.ndarray], bucket: int) -> None:
        mine = [s[: np.searchsorted(s, bucket)] for s in sketches]
        owner, flat = np.repeat(np.arange(len(mine)), [len(s) for s in mine]), np.concatenate(mine)
        names, which, times = np.unique(flat, return_inverse=True, return_counts=True)
        column = np.full(len(names), -1)
        several = np.flatnonzero(times > 1)
        column[several] = np.arange(len(several))
        self.members, self.columns = len(mine), len(several)
        self.owner, self.which = owner[column[which] >= 0], column[which][column[which] >= 0]
        self.last: tuple[int, np.ndarray] | None = None

    def _has(self, k: int) -> np.ndarray:
        """Which member is in which of the buckets from ``k`` on; the last asked for is kept."""
        if self.last is None or self.last[0] != k:
            has = np.zeros((self.members, min(WIDE, self.columns - k)), np.float32)
            now = (self.which >= k) & (self.which < k + WIDE)
            has[self.owner[now], self.which[now] - k] = 1
            self.last = k, has
        return self.last[1]

    def shared(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of members ``left`` and ``right`` (rows and columns)."""
        out = np.zeros((len(left), len(right)), bool)
        for k in range(0, self.columns, WIDE):
            has = self._has(k)
            out |= has[left] @ has[right].T > 0
        return out


def _nearest(ids: np.ndarray, of: np.ndarray, a: np.ndarray, b: np.ndarray, bound: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Which pairs of members are the nearest of a class (in their group), of equals those of the smallest ids."""
    if not len(a):
        return np.zeros(0, np.int64)
    side, pair = np.concatenate([of[a], of[b]]), np.tile(np.arange(len(a)), 2)
    group = np.zeros(len(pair), np.int64) if group is None else group[pair]
    by = np.lexsort((np.maximum(ids[a], ids[b])[pair], np.minimum(ids[a], ids[b])[pair], bound[pair], side, group))
    return np.unique(pair[by[np.flatnonzero(np.r_[True, (np.diff(side[by]) != 0) | (np.diff(group[by]) != 0)])]])


def _block(t: pa.Table, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different classes of one block (members of salts low and high of a bucket's bands) that may be alike; or the nearest of each class.

    Members are taken in order of length, so that a strip of them meets those of like lengths only, and of two of one salt the second only.
    """
    ids, n, of, salt, own = (t.column(c).to_numpy(zero_copy_only=False) for c in ("id", "n", "class", "salt", "own"))
    none = np.zeros(0, np.int64)
    if of.min() == of.max():
        return none, none
    low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
    order = np.lexsort((ids, n))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    all_left, all_right = order[salt[order] == low], order[salt[order] == high]
    if not len(all_left) or not len(all_right):
        return none, none
    lengths = n[all_right]
    folds = np.frombuffer(b"".join(t.column("folds").to_pylist()), np.uint8).reshape(-1, FOLDS)
    steps, rest = _common(folds, n)
    earlier = None if nearest else _Earlier([np.sort(np.array(s, np.int64)) for s in t.column("sketch").to_pylist()], t.column("bucket")[0].as_py())
    found = []
    for k in range(0, len(all_left), STRIP):
        left = all_left[k : k + STRIP]
        start = k if low == high else np.searchsorted(lengths, LEAST * n[left[0]] - 1)
        right = all_right[start : np.searchsorted(lengths, n[left[-1]] / LEAST + 1, "right")]
        if not own[left].any():  # two of the band above meet there
            right = right[own[right]]
        if not len(right):
            continue
        left, right = left[np.argsort(ids[left], kind="stable")], right[np.argsort(ids[right], kind="stable")]
        longer, shorter = (f(n[left][:, None], n[right][None, :]) for f in (np.maximum, np.minimum))
        most = np.floor((1 - LEAST) * longer + 1e-9)
        bound = longer - steps[left] @ steps[right].T - np.minimum(rest[left][:, None], rest[right][None, :])
        fit = (bound <= most) & (longer - shorter <= most)
        fit &= (of[left][:, None] != of[right][None, :]) & (ids[left][:, None] != ids[right][None, :])
        fit &= own[left][:, None] | own[right][None, :]
        if low == high:
            fit &= place[left][:, None] < place[right][None, :]
        if earlier and fit.any():
            fit &= ~earlier.shared(left, right)
        if nearest:  # the nearest of each member, by this bound
            bound[~fit] = np.inf
            x, y = np.r_[np.arange(len(left)), bound.argmin(0)], np.r_[bound.argmin(1), np.arange(len(right))]
            x, y = np.divmod(np.unique((x * len(right) + y)[fit[x, y]]), len(right))
        else:
            x, y = np.nonzero(fit)
        for i in range(0, len(x), 1 << 12):
            a, b, limit = left[x[i : i + (1 << 12)]], right[y[i : i + (1 << 12)]], most[x[i : i + (1 << 12)], y[i : i + (1 << 12)]]
            lost = np.minimum(n[a] - folds[a].sum(1, dtype=np.int64), n[b] - folds[b].sum(1, dtype=np.int64))  # counts above 255
            bound = np.maximum(n[a], n[b]) - np.minimum(folds[a], folds[b]).sum(1, dtype=np.int64) - lost
            good = bound <= limit
            a, b, bound = a[good], b[good], bound[good]
            found.append([x.astype(np.int32) for x in (a, b, bound)[: 3 if nearest else 2]])
    if not found:
        return none, none
    a, b, *bound = (np.concatenate(f) for f in zip(*found))
    if nearest:
        keep = _nearest(ids, of, a, b, *bound)
        a, b = a[keep], b[keep]
    return np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])


def _small(t: pa.Table, starts: np.ndarray, sizes: np.ndarray, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """What ``_block`` finds, for many blocks of few members at once: all their pairs are laid side by side."""
    ids, n, of, salt, own, bucket, low, high = (t.column(c).to_numpy(zero_copy_only=False) for c in ("id", "n", "class", "salt", "own", "bucket", "low", "high"))
    member = ranges(starts, sizes)
    after = np.repeat(starts + sizes, sizes) - member - 1  # members of its block behind each
    group = np.repeat(np.repeat(np.arange(len(starts)), sizes), after)
    a, b = np.repeat(member, after), ranges(member + 1, after)
    longer, shorter = np.maximum(n[a], n[b]), np.minimum(n[a], n[b])
    most = np.floor((1 - LEAST) * longer + 1e-9)
    fit = (of[a] != of[b]) & (ids[a] != ids[b]) & (longer - shorter <= most) & (own[a] | own[b])
    fit &= (low[a] == high[a]) | (salt[a] != salt[b])  # two of one salt meet in their own block
    a, b, group, longer, most = a[fit], b[fit], group[fit], longer[fit], most[fit]
    folds = np.frombuffer(b"".join(t.column("folds").to_pylist()), np.uint8).reshape(-1, FOLDS)
    whole = folds.sum(1, dtype=np.int64)
    both = np.concatenate([np.zeros(0, np.int64), *(np.minimum(folds[a[k : k + 4096]], folds[b[k : k + 4096]]).sum(1, dtype=np.int64) for k in range(0, len(a), 4096))])
    bound = longer - both - np.minimum(n[a] - whole[a], n[b] - whole[b])
    fit = bound <= most
    a, b, group, bound = a[fit], b[fit], group[fit], bound[fit]
    if nearest:
        keep = _nearest(ids, of, a, b, bound, group)
    else:
        held = t.column("sketch").take(pa.array(np.r_[a, b])).to_pylist()
        keep = np.array([k for k in range(len(a)) if min(set(held[k]) & set(held[k + len(a)])) == bucket[a[k]]], np.int64)
    a, b = ids[a[keep]], ids[b[keep]]
    return np.minimum(a, b), np.maximum(a, b)


def _meet(batches: Iterator[pa.RecordBatch], nearest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of different classes that may be alike, from rows in order of bucket, band and block (low, high): the nearest of each class, or all."""

    def found(t: pa.Table, starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        few = sizes <= FEW
        pairs = [_small(t, starts[few], sizes[few], nearest)] if few.any() else []
        pairs += [_block(t.slice(x, size), nearest) for x, size in zip(starts[~few].tolist(), sizes[~few].tolist())]
        a, b = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in pairs)]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        if not len(t):
            continue
        key = np.stack([t.column(c).to_numpy() for c in ("bucket", "band", "low", "high")])
        starts = np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1]
        yield found(t.slice(0, starts[-1]), starts[:-1], np.diff(starts))
        rest = t.slice(starts[-1])
    if rest is not None:
        yield found(rest, np.array([0]), np.array([len(rest)]))


def edits(a: list, b: list, most: int) -> int | None:
    """Least number of word edits between ``a`` and ``b`` if at most ``most``.

    The table of the alignment is filled column by column inside the band of ``most`` on either side of
    its diagonal; a column's differences, up and down, are the bits of two numbers, of which the lowest
    stands for the band's upper edge.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return None
    start, n, m = 0, len(a), len(b)
    while start < m and a[start] == b[start]:
        start += 1
    while m > start and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[start:n], b[start:m]
    n, m = len(a), len(b)
    if not m:
        return n
    most = min(most, n)  # as many edits change all
    if not most:
        return None
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    width = 2 * most + 2
    mask, bottom = (1 << width) - 1, 1 << (width - 1)
    up, down = ((1 << (most + 1)) - 1) << (width - most - 1), 0
    cost, shift, line = most, most + 1 - width, bottom >> 1
    give_up = 2 * most + m - n
    for j, w in enumerate(b):
        match = places.get(w, 0)
        match = (match << -shift if shift < 0 else match >> shift) & mask
        shift += 1
        diagonal = ((((match & up) + up) ^ up) | match | down) & mask
        right_up, right_down = down | mask & ~(diagonal | up), diagonal & up
        if j < n - most:  # down the band's lower edge
            cost += not diagonal & bottom
        else:  # along the last row
            cost += bool(right_up & line) - bool(right_down & line)
            line >>= 1
        if cost > give_up:
            return None
        diagonal >>= 1
        up, down = right_down | mask & ~(diagonal | right_up), diagonal & right_up
    return cost if cost <= most else None


def alike(x: list[str], y: list[str], least: float = LEAST) -> bool:
    """Whether the alignment of the words reaches the similarity."""
    most = math.floor((1 - least) * max(len(x), len(y)) + 1e-9)
    if abs(len(x) - len(y)) > most:
        return False
    both = (Counter(x) & Counter(y)).total()
    return max(len(x), len(y)) - both <= most and edits(x, y, most) is not None


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, parts in sliced(batches, TEXT_BYTES, "text_a"):
        rows = zip(parts, texts(batch.column("text_b")))
        good = [alike(*(raw.decode("utf-8", "replace").lower().split() for raw in pair)) for pair in rows]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, parts in sliced(batches, TEXT_BYTES):
        yield pa.RecordBatch.from_arrays([pa.array([_key(raw.decode("utf-8", "replace").lower().split()) for raw in parts], pa.binary()), batch.column("text")], names=["key", "text"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that may be alike by their folded counts of words."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, FOLDS) for c in ("folds_a", "folds_b"))
        n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
        lost = np.minimum(n - x.sum(1, dtype=np.int64), m - y.sum(1, dtype=np.int64))  # counts above 255
        bound = np.maximum(n, m) - np.minimum(x, y).sum(1, dtype=np.int64) - lost
        yield batch.select(["a", "b"]).filter(pa.array(bound <= np.floor((1 - LEAST) * np.maximum(n, m) + 1e-9)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of 32 bits of each text's words, in order."""
    for batch, parts in sliced(batches, PART):
        _, count, h = _words(parts)
        h = h.astype(np.uint32)
        said = [h[b - n : b].tobytes() for b, n in zip(np.cumsum(count), count)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), batch.column("cells"), pa.array(said, pa.binary())], names=["node", "n", "cells", "said"])


def _widely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's counters of words, by length."""
    for batch, parts in sliced(batches, PART):
        _, count, h = _words(parts)
        said = [widened(h[b - n : b]) for b, n in zip(np.cumsum(count), count)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), batch.column("cells"), pa.array(said, pa.binary())], names=["node", "n", "cells", "said"])


def _near_widely(pairs: pa.Table, held: pa.Table) -> pa.Table:
    """Pairs of two groups of texts that may be alike by their counters of words."""
    at = {node: i for i, node in enumerate(held.column("node").to_pylist())}
    n, said = held.column("n").to_pylist(), [np.frombuffer(x, np.uint16) for x in held.column("said").to_pylist()]
    ends = zip((at[x] for x in pairs.column("a").to_pylist()), (at[x] for x in pairs.column("b").to_pylist()))
    good = [apart(said[i], n[i], said[j], n[j]) <= math.floor((1 - LEAST) * max(n[i], n[j]) + 1e-9) for i, j in ends]
    return pairs.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def common(x: np.ndarray, y: np.ndarray) -> int:
    """No less than the words in common, of two texts' labelled words; equal hashes of unlike words only add."""
    both = np.sort(np.concatenate((x, y)))
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _near_doubled(pairs: pa.Table, held: pa.Table, aligned: bool = False) -> pa.Table:
    """Pairs of two groups of texts that may be alike by their counts of each two words and their words in common, and ``aligned`` by their words' hashes."""
    at = {node: i for i, node in enumerate(held.column("node").to_pylist())}
    said = [np.frombuffer(x, np.uint32) for x in held.column("said").to_pylist()]
    counts = [np.frombuffer(doubled(x.astype(_U)), np.uint8) for x in said]

    @functools.lru_cache(None)
    def words(i: int) -> np.ndarray:
        return labelled(said[i].astype(_U), np.array([len(said[i])])).astype(np.uint32)

    def near(i: int, j: int) -> bool:
        longer = max(len(said[i]), len(said[j]))
        most = math.floor((1 - LEAST) * longer + 1e-9)
        if difference(counts[i], counts[j]) > 4 * most or longer - common(words(i), words(j)) > most:
            return False
        return not aligned or edits(said[i].tolist(), said[j].tolist(), most) is not None

    good = [near(at[a], at[b]) for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist())]
    return pairs.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


class _Texts:
    """The distinct texts (node, key, n, sketch, folds) and where their words are found: by id, or by key if ids repeat."""

    def __init__(self, rows: DataFrame, base: DataFrame) -> None:
        self.rows = rows
        found = base.groupBy("key").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.min("folds").alias("folds"))
        self.again = not base.groupBy("id").count().where("count > 1 or id is null").isEmpty()
        if self.again:  # unlike texts of one id, and texts without id, are nodes of their own
            first = F.row_number().over(Window.partitionBy("id").orderBy("key")) == 1
            found = found.withColumn("node", F.when(first & F.col("id").isNotNull(), F.col("id")).otherwise(F.xxhash64("key", "id")))
        else:
            found = found.withColumn("node", F.col("id"))
        self.table = cut(found, "omh-texts")
        self.most = max(SENT_BYTES, int(4 * SENT * (self.table.agg(F.sum("n")).first()[0] or 0)))

    def narrow(self) -> None:
        """Sketches are needed no more."""
        table = cut(self.table.drop("sketch"), "omh-narrow")
        release(table.sparkSession, self.table)
        self.table = table

    def said(self, nodes: DataFrame) -> DataFrame:
        """``nodes`` (node, and others) with their text."""
        nodes = F.broadcast(nodes) if nodes.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else nodes
        if self.again:
            keys = self.table.select("key", "node").join(nodes, "node")
            return self.rows.mapInArrow(tidy(_keyed), "key binary, text string").join(keys, "key").dropDuplicates(["node"]).drop("key")
        return self.rows.withColumnRenamed("id", "node").join(nodes, "node")

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that may be alike by their folded counts of words."""
        of = lambda x: self.table.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("folds").alias(f"folds_{x}"))
        bound_batches(pairs.sparkSession, 4096)
        return cut(pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").mapInArrow(tidy(_near), "a long, b long"), "omh-near")

    def judged(self, pairs: DataFrame, name: str, made: Callable, each: int, bound: int, judge: Callable) -> DataFrame:
        """The pairs (a, b) that ``judge`` leaves of pairs and of what ``made`` makes of their texts, ``each`` bytes a word.

        Texts are dealt to groups of ``bound`` bytes; a pair is judged in the cell of its two groups, and a text is sent to each of its
        cells once. Cells are dealt to passes, so that what is sent in one stays within a share of the texts.
        """
        spark = pairs.sparkSession
        both = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
        words = self.table.join(both.distinct(), "node").agg(F.sum("n")).first()[0] or 0
        groups = max(GROUPS, math.ceil(each * words / bound), math.ceil(math.sqrt(pairs.count() / GROUP_PAIRS)))
        group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups))
        cell = F.least(group("a"), group("b")) * groups + F.greatest(group("a"), group("b"))
        dealt = pairs.select("a", "b", cell.alias("cell"))
        nodes = dealt.select(F.col("a").alias("node"), "cell").union(dealt.select("b", "cell")).groupBy("node").agg(F.collect_set("cell").alias("cells"))
        nodes = cut(nodes.join(self.table.select("node", "n"), "node"), "omh-cells")
        sent = each * (nodes.agg(F.sum(F.col("n") * F.size("cells"))).first()[0] or 0)
        passes = max(1, math.ceil(sent / self.most))
        turn = lambda c: F.pmod(F.xxhash64(c), F.lit(passes))
        bound_batches(spark, 64)
        out = []
        for k in range(passes):
            asked, now = nodes, dealt
            if passes > 1:
                asked = nodes.withColumn("cells", F.filter("cells", lambda c: turn(c) == k)).where(F.size("cells") > 0)
                now = dealt.where(turn("cell") == k)
            held = self.said(asked).select("node", "n", "cells", "text").mapInArrow(tidy(made), "node long, n int, cells array<long>, said binary")
            held = held.select("node", "n", "said", F.explode("cells").alias("cell"))
            out.append(cut(now.groupBy("cell").cogroup(held.groupBy("cell")).applyInArrow(judge, "a long, b long"), name))
            forget_shuffles(spark)
        release(spark, nodes)
        if passes == 1:
            return out[0]
        whole = cut(functools.reduce(DataFrame.unionByName, out), name)
        release(spark, *out)
        return whole

    def near_widely(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that may be alike by their counters of words, more for longer texts (``widened``)."""
        return self.judged(pairs, "omh-widely", _widely, 1, WIDE_BYTES, _near_widely)

    def near_doubled(self, pairs: DataFrame, aligned: bool) -> DataFrame:
        """The pairs (a, b) that may be alike by their counts of each two words and more (``_near_doubled``)."""
        return self.judged(pairs, "omh-doubled", _counted, 4, GROUP_BYTES, lambda x, y: _near_doubled(x, y, aligned))

    def links(self, pairs: DataFrame, aligned: bool = False) -> DataFrame:
        """The pairs (a, b) whose alignment reaches the similarity; where few do, ``aligned`` spares the others' texts."""
        spark = pairs.sparkSession
        pairs = self.near_doubled(pairs, aligned)
        ids = cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "omh-ids")
        held = cut(self.said(ids).select("node", "text"), "omh-held")
        a, b = held.select(F.col("node").alias("a"), F.col("text").alias("text_a")), held.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        both = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
        bound_batches(spark, 64)
        out = cut(both.mapInArrow(tidy(_verify), "a long, b long"), "omh-links")
        release(spark, pairs, ids, held)
        forget_shuffles(spark)
        return out


def _rest(members: DataFrame, labels: DataFrame, known: DataFrame, done: DataFrame, nearest: bool, most: int) -> DataFrame:
    """Pairs (a, b) of different classes of one bucket that may be alike and are not in ``done``: the nearest of each class, or all.

    Alike texts are of one band of lengths or of two in a row: a member is in the group of its own band and of that below.
    Members are sent to blocks in passes of about ``most`` bytes.
    """
    spark = members.sparkSession
    labelled = members.join(labels, members.id == labels.node, "left").select("id", "bucket", "n", F.coalesce("label", "id").alias("class"))
    mixed = labelled.groupBy("bucket").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x < y").select("bucket")
    band = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / math.log(1 / LEAST)).cast("int")
    grouped = labelled.join(mixed, "bucket").withColumn("own", F.explode(F.array(F.lit(True), F.lit(False))))
    grouped = cut(grouped.withColumn("band", F.when(F.col("own"), band).otherwise(band - 1)), "omh-mixed")
    sizes = grouped.groupBy("bucket", "band").agg(F.count("*").alias("size"), F.min("class").alias("x"), F.max("class").alias("y"), F.max("own").alias("any"))
    sizes = sizes.where("x < y and any").select("bucket", "band", "size", F.ceil(F.col("size") / BLOCK).cast("int").alias("salts"))
    passes = max(1, math.ceil(MEMBER_BYTES * (sizes.agg(F.sum(F.col("size") * F.col("salts"))).first()[0] or 0) / most))
    dealt = grouped.join(sizes.drop("size"), ["bucket", "band"]).withColumn("salt", F.pmod(F.xxhash64("id"), "salts").cast("int"))
    more = known.select(F.col("node").alias("id"), "folds")
    if not nearest:  # a pair is compared in the smallest of the buckets that it shares and that still hold several classes
        more = more.join(grouped.where("own").groupBy("id").agg(F.collect_list("bucket").alias("sketch")), "id")
    wide = dealt.join(more, "id")
    wide = wide.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    wide = wide.select("bucket", "band", F.least("salt", "to").alias("low"), F.greatest("salt", "to").alias("high"), "salt", "id", "n", "class", "own", *more.columns[1:])
    bound_batches(spark, 4096)
    keys = ["bucket", "band", "low", "high"]
    met = []
    for k in range(passes):
        now = wide.where(F.pmod(F.xxhash64(*keys), F.lit(passes)) == k) if passes > 1 else wide
        met.append(cut(now.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(lambda batches: _meet(batches, nearest)), "a long, b long"), "omh-met"))
        forget_shuffles(spark)
    out = cut(functools.reduce(DataFrame.unionByName, met).distinct().join(done, ["a", "b"], "left_anti"), "omh-rest")
    release(spark, grouped, *met)
    forget_shuffles(spark)
    return out


class _Classes:
    """key (of the words) and the class of each distinct text, and base: id and key of each row."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str) -> None:
        self.spark = spark = docs.sparkSession
        bound_batches(spark)
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        base = cut(rows.mapInArrow(tidy(_sketched), "id long, key binary, n int, sketch array<long>, folds binary"), "omh-sketches")
        self.texts = _Texts(rows, base)
        self.base = cut(base.select("id", "key"), "omh-rows")
        release(spark, base)
        forget_shuffles(spark)
        buckets = self.texts.table.select(F.explode("sketch").alias("bucket"), "n", F.col("node").alias("id"))
        dealt = buckets.repartitionByRange("bucket", "n", "id").sortWithinPartitions("bucket", "n", "id")
        bound_batches(spark, 8192)
        walked = cut(dealt.mapInArrow(tidy(_walk), "a long, b long, bucket long, n int, kind byte"), "omh-walk")
        self.texts.narrow()
        known = self.texts.table
        forget_shuffles(spark)
        # a bucket that goes on in the next partition: at most two rows of each partition
        ends = walked.where("kind = 1").select(F.col("a").alias("id"), "bucket", "n").distinct()
        order = Window.partitionBy("bucket").orderBy("n", "id")
        ends = ends.select(F.lag("id").over(order).alias("was"), F.lag("n").over(order).alias("was_n"), "id", "n").where(F.col("was_n") >= LEAST * F.col("n"))
        ends = ends.select(F.least("was", "id").alias("a"), F.greatest("was", "id").alias("b"))
        pairs = walked.where("kind = 0").select("a", "b").unionByName(ends).groupBy("a", "b").count()
        first = cut(pairs.groupBy("b").agg(F.max_by("a", F.struct("count", -F.col("a"))).alias("a")), "omh-first")
        near = self.texts.near(first)
        links = [self.texts.links(near)]
        release(spark, near)
        labels = components(links[0])
        members = cut(walked.where("kind <> 0").select(F.col("a").alias("id"), "bucket", "n").distinct(), "omh-members")
        release(spark, walked)
        done = first.select("a", "b")
        for nearest in (True, False):
            rest = _rest(members, labels, known, done, nearest, self.texts.most)
            if not rest.isEmpty():
                near = self.texts.near_widely(rest)
                links.append(self.texts.links(near, aligned=not nearest))
                release(spark, near)
                labels = components(functools.reduce(DataFrame.unionByName, links))
                done = done.unionByName(rest)
        release(spark, members, *links)

        # the class goes by its smallest id, and of texts of that id by the smallest key
        of = known.select("key", "node", "id").join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("key", "id", F.coalesce("label", "node").alias("class"))
        if self.texts.again:
            best = of.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best"))
            of = of.join(best, "class").select("key", F.col("best.id").alias("class_id"), (F.col("key") == F.col("best.key")).alias("first"))
        else:
            of = of.select("key", F.col("class").alias("class_id"), (F.col("id") == F.col("class")).alias("first"))
        self.table = cut(of, "omh-classes")
        release(spark, known)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col`` and class_id, the smallest id of its class."""
    found = _Classes(docs, id_col, text_col)
    class_id = F.when(F.col("id").isNotNull(), F.col("class_id")).alias("class_id")
    return found.base.select("id", "key").join(found.table, "key").select("id", class_id).withColumnRenamed("id", id_col)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, class_id, kept: the smallest id of a class stays."""
    found = classes(docs, id_col, text_col)
    return found.withColumn("kept", F.coalesce(F.col(id_col) == F.col("class_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, one of its smallest id; all columns stay as they are.

    Decided by id where ids tell rows apart, else by id and words, so ids may repeat, with equal or unlike
    texts, or be null (larger than every id).
    """
    found = _Classes(docs, id_col, text_col)
    rows = found.base.select("id", "key").join(found.table, "key")
    if not found.texts.again:
        gone = cut(rows.where("not first").select(F.col("id").alias(id_col)), "omh-dropped")
        release(docs.sparkSession, found.base, found.table)
        return docs.join(gone, id_col, "left_anti")
    key, of, least = (fresh(docs, f"class_{x}") for x in ("key", "of", "least"))
    stays = found.table.where("first").select(F.col("key").alias(of), F.col("class_id").alias(least))
    schema = StructType([*docs.schema.fields, StructField(key, BinaryType())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, parts in sliced(batches, TEXT_BYTES, text_col):
            yield batch.append_column(key, pa.array([_key(x.decode("utf-8", "replace").lower().split()) for x in parts], pa.binary()))

    held = docs.mapInArrow(tidy(keyed), schema).join(stays, F.col(key) == F.col(of))
    return held.where(F.col(id_col).cast("long").eqNullSafe(F.col(least))).dropDuplicates([key]).drop(key, of, least)
