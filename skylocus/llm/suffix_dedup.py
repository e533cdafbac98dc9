"""Repeated passages by suffix arrays built with linear grouping.

Texts are UTF-8 bytes. A byte goes if it is covered by a ``WIDTH``-byte string that also starts in a
document with a smaller id, judged on the input; matches never cross documents.

No machine can sort the suffixes of a corpus, so they are dealt out exactly: each string of WIDTH bytes
is filed under the leftmost smallest hash of its ``GRAM``-byte pieces, which equal strings share. The
strings of a document under one such anchor lie side by side and form a stretch. First only the anchors'
hashes meet, one for each chunk of documents that has it; the stretches under anchors of several documents
are then taken from the chunks, equal ones as one with their smallest id, and sent to the anchor's group.
Of whole copies only the smallest id is looked at, the others go entirely. All groups of a task's batch
that hold unlike stretches are sorted at once: suffixes are grouped by their Lyndon prefix,
groups taken in descending order along previous-smaller pointers, and each group's order then emitted
from the ranks of the next smaller suffixes. Neighbours in the array that agree on WIDTH bytes form a
run, and the smallest id of the run decides. A group of more than ``GROUP_TEXTS`` stretches is refiled, each string
under its own hash, so none grows with the corpus.

Cases: null text is empty; texts under WIDTH bytes lose nothing; a null id counts as larger than every
id; a very long text is a chunk of its own and needs some forty times its bytes; a repeated row is judged like its twin; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, forget_shuffles, ranges, release, sliced, texts, tidy

WIDTH = 50
GRAM = 26
#: Strings of one stretch at most.
STRETCH = 64
#: Distinct stretches of one group beyond which it is refiled by single strings.
GROUP_TEXTS = 4096
#: Bytes of stretches sorted at once, give or take a group.
SORT_BYTES = 1 << 20
#: Bytes of documents hashed at once, give or take a document.
HASH_BYTES = 1 << 20
#: Chunks whose anchors' share of one part is held at once, some 80,000 anchors each, where the shuffle's partitions do not ask for smaller parts.
PART_CHUNKS = 32
#: Rows of an Arrow batch of numbers; those of texts are bounded by bytes.
TABLE_ROWS = 1 << 14
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
PLACES = "array<struct<id: long, mark: long, at: int>>"
LAST = (1 << 63) - 1
RUNS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("low", pa.int64())]))

_BASE = np.uint64(0x9E3779B97F4A7C15)
_KEPT: dict[np.uint64, np.ndarray] = {}
_TABLE = np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.uint64)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before; the first does."""
    new = np.empty(len(columns[0]), bool)
    new[:1] = True
    np.not_equal(columns[0][1:], columns[0][:-1], out=new[1:])
    for column in columns[1:]:
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def widths(starts: np.ndarray, end: int) -> np.ndarray:
    """From each start to the next, the last to ``end``."""
    out = np.empty(len(starts), np.int64)
    np.subtract(starts[1:], starts[:-1], out=out[:-1])
    out[-1:] = end - starts[-1:]
    return out


def suffix_array(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Suffix arrays of ``symbols[bounds[k]:bounds[k + 1]]``, end to end, all built side by side.

    Each string must end in its only smallest symbol. A group is known by the slot where it begins.
    """
    n = len(symbols)
    problem = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    # keys of 16 bits are sorted by radix
    small = [x.astype(np.uint16) if n and 0 <= x.min() and x.max() < 1 << 16 else x for x in (symbols, problem)]
    order = np.lexsort(small)
    fresh = changes(symbols[order], problem[order])
    sizes = widths(fresh, n)
    group, size, slot = np.empty(n + 1, np.int64), np.zeros(n + 1, np.int64), np.empty(n, np.int64)
    group[order], group[n] = np.repeat(fresh, sizes), -1
    size[fresh] = sizes
    slot[order] = np.arange(n)
    before = np.arange(-1, n)
    before[bounds[:-1]] = n
    before[n] = n
    hit = np.zeros(n, bool)
    low, top = bounds[:-1], bounds[1:].copy()
    while True:
        live = np.flatnonzero(top > low)
        if not len(live):
            break
        end = top[live]
        start = group[order[end - 1]]
        top[live] = start
        members = order[ranges(start, end - start)]
        own, todo = np.repeat(start, end - start), members
        while len(todo):  # follow previous-smaller pointers out of this and all higher groups
            at = before[todo]
            up = group[at] >= own
            todo, own = todo[up], own[up]
            before[todo] = before[at[up]]
        smaller = before[members]
        found = np.sort(smaller[smaller < n])
        if not len(found):
            continue
        first = changes(found)
        times, found = widths(first, len(found)), found[first]
        old = group[found]
        by = np.lexsort((times, old))
        found, old, times = found[by], old[by], times[by]
        first = changes(old)
        count = widths(first, len(found))
        tail = old[first] + size[old[first]] - count
        slots = ranges(tail, count)
        hit[found] = True
        held = order[slots]
        stay = held[~hit[held]]
        freed = slot[found]
        freed = freed[freed < np.repeat(tail, count)]
        order[freed], slot[stay] = stay, freed
        order[slots], slot[found] = found, slots
        hit[found] = False
        runs = changes(old, times)
        lengths = widths(runs, len(found))
        size[old[first]] -= count
        size[slots[runs]] = lengths
        group[found] = np.repeat(slots[runs], lengths)

    after = np.arange(1, n + 2)  # the next suffix that is smaller ends the Lyndon prefix
    after[n] = n
    todo = np.arange(n)
    while len(todo):
        at = after[todo]
        up = group[at] > group[todo]
        todo = todo[up]
        after[todo] = after[at[up]]
    rank = np.full(n + 1, -1)
    lead = np.zeros(n, bool)
    lead[group[:n]] = True
    heads = np.flatnonzero(lead)
    single = order[heads[size[heads] == 1]]
    rank[single] = group[single]
    heads = heads[size[heads] > 1]
    owner = problem[order[heads]]
    turn = np.arange(len(heads)) - np.searchsorted(owner, owner)
    by = np.argsort(turn, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(turn[by]) != 0]) if len(by) else []
    for heads_now in np.split(heads[by], cuts[1:]) if len(by) else []:  # ascending in each string
        fill = heads_now.copy()
        index = np.repeat(np.arange(len(heads_now)), size[heads_now])
        pending = order[ranges(heads_now, size[heads_now])]
        while len(pending):
            below = rank[after[pending]]
            ready = below >= 0
            which, chosen = index[ready], pending[ready]
            line = np.lexsort((below[ready], which))
            which, chosen = which[line], chosen[line]
            new = np.bincount(which, minlength=len(heads_now))
            rank[chosen] = fill[which] + np.arange(len(which)) - (np.cumsum(new) - new)[which]
            fill += new
            pending, index = pending[~ready], index[~ready]
    result = np.empty(n, np.int64)
    result[rank[:n]] = np.arange(n)
    return result


def anchors(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each stretch: index of its text, hash of its anchor, start in the text and length."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    lengths = np.array([len(p) for p in parts], np.int64)
    offsets = np.cumsum(lengths) - lengths
    starts = ranges(offsets, np.maximum(lengths - WIDTH + 1, 0))
    if not len(starts):
        none = np.empty(0, np.int64)
        return none, none, none, none
    with np.errstate(over="ignore"):
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_TABLE[data] * _powers(_BASE, len(data)), out=total[1:])
        code = total[GRAM:] - total[:-GRAM]
        code *= _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), len(code))
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        code ^= code >> np.uint64(32)
    span, wanted = 1, WIDTH - GRAM + 1
    while span < wanted:  # the least hash among so many pieces from each byte on
        step = min(span, wanted - span)
        code, span = np.minimum(code[:-step], code[step:]), span + step
    code = code[starts]
    fresh = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (np.diff(starts) != 1)])
    times = np.diff(np.r_[fresh, len(starts)])
    pieces = -(-times // STRETCH)  # periodic text keeps one anchor for long
    first = np.repeat(fresh, pieces) + ranges(np.zeros(len(fresh), np.int64), pieces) * STRETCH
    begin = starts[first]
    row = np.searchsorted(offsets, begin, side="right") - 1
    return row, code[first].view(np.int64), begin - offsets[row], np.diff(np.r_[first, len(starts)]) + WIDTH - 1


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base, base ** 2, ... modulo 2 ** 64; kept for texts of usual size."""
    if n > 2 * HASH_BYTES:
        return np.multiply.accumulate(np.full(n, base))
    if base not in _KEPT:
        _KEPT[base] = np.multiply.accumulate(np.full(2 * HASH_BYTES, base))
    return _KEPT[base][:n]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in chunks of some HASH_BYTES, or of one document."""
    for batch, _ in sliced(batches, HASH_BYTES):
        lists = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), pa.concat_arrays([batch.column(c).cast(t)])) for c, t in (("id", pa.int64()), ("mark", pa.int64()), ("text", pa.binary()))]
        yield pa.RecordBatch.from_arrays(lists, names=["ids", "marks", "texts"])


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each anchor of a chunk once; the tag is twice the chunk, and one more if several of its documents have the anchor."""
    for batch in batches:
        for chunk, parts in zip(batch.column("chunk").to_pylist(), batch.column("texts")):
            row, code, _, _ = anchors(parts.as_py())
            by = np.argsort(code)
            code, row = code[by], row[by]
            run = changes(code)
            many = np.minimum.reduceat(row, run) != np.maximum.reduceat(row, run) if len(code) else by
            for k in range(0, len(run), 1 << 17):
                s = slice(k, k + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(code[run[s]]), pa.array(2 * chunk + many[s].astype(np.int64))], names=["code", "tag"])


def _packed(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The anchors of ``_codes`` dealt to ``parts`` by their codes, as one row for each chunk and part."""
    for batch in _codes(batches):
        code, tag = (batch.column(c).to_numpy() for c in ("code", "tag"))
        part = ((code & 0xFFFFFFFF) * parts >> 32).astype(np.uint16)
        by = np.argsort(part, kind="stable")
        ends = np.r_[0, np.cumsum(np.bincount(part, minlength=parts))]
        full = np.flatnonzero(ends[1:] > ends[:-1])
        at = pa.py_buffer((np.r_[0, ends[full + 1]] * 8).astype(np.int32))
        columns = [pa.BinaryArray.from_buffers(pa.binary(), len(full), [None, at, pa.py_buffer(x[by])]) for x in (code, tag)]
        out = pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *columns], names=["part", "codes", "tags"])
        for k in range(0, out.num_rows, 1 << 10):
            yield out.slice(k, 1 << 10)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_meet`` of each part; rows come sorted by part."""

    def met(held: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        code, tag = (np.frombuffer(b"".join(x), np.int64) for x in zip(*held))
        by = np.argsort(code)
        yield from _meet(iter([pa.RecordBatch.from_arrays([pa.array(code[by]), pa.array(tag[by])], names=["code", "tag"])]))

    last, held = None, []
    for batch in batches:
        for part, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "codes", "tags"))):
            if part != last and held:
                yield from met(held)
                held = []
            last = part
            held.append(row)
    if held:
        yield from met(held)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk and code of anchors that several documents have; rows come sorted by code, of which one may have any number."""
    last = tag = None  # the code that ended the batch before, and its tag if that stands alone so far
    for batch in batches:
        code, tags = (batch.column(c).to_numpy() for c in ("code", "tag"))
        known = tag is None and last is not None and code[0] == last
        if tag is not None:
            code, tags = np.r_[last, code], np.r_[tag, tags]
        run = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        times = np.diff(np.r_[run, len(code)])
        shared = (times > 1) | (tags[run] & 1 == 1)
        shared[0] |= known
        last, tag = code[-1], None if shared[-1] else tags[-1]
        keep = np.repeat(shared, times)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(tags[keep] >> 1), pa.array(code[keep])], names=["chunk", "code"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct stretches of each chunk under its shared anchors, with their smallest and largest id and their places."""
    for batch in batches:
        for ids, marks, parts, codes in zip(*(batch.column(c) for c in ("ids", "marks", "texts", "codes"))):
            parts, shared = parts.as_py(), np.sort(codes.values.to_numpy())
            row, code, at, size = anchors(parts)
            wanted = shared[np.minimum(np.searchsorted(shared, code), len(shared) - 1)] == code
            row, code, at, size = row[wanted], code[wanted], at[wanted], size[wanted]
            found: dict[bytes, int] = {}
            index = np.array([found.setdefault(parts[r][a:b], len(found)) for r, a, b in zip(row.tolist(), at.tolist(), (at + size).tolist())], np.int64)
            if not len(index):
                continue
            by = np.argsort(index, kind="stable")
            run = np.flatnonzero(np.r_[True, np.diff(index[by]) != 0])
            ids, marks = (x.values.to_numpy()[row[by]] for x in (ids, marks))
            places = pa.StructArray.from_arrays([pa.array(ids), pa.array(marks), pa.array(at[by], pa.int32())], ["id", "mark", "at"])
            columns = [pa.array(code[by[run]]), pa.array(list(found), pa.binary()), pa.array(np.minimum.reduceat(ids, run)), pa.array(np.maximum.reduceat(ids, run)), pa.ListArray.from_arrays(pa.array(np.r_[run, len(by)], pa.int32()), places)]
            out = pa.RecordBatch.from_arrays(columns, names=["code", "piece", "low", "high", "places"])
            for k in range(0, out.num_rows, 1 << 13):
                yield out.slice(k, 1 << 13)


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each stretch, the smallest id of each string in it; rows come sorted by code."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("code", "piece", "low", "high"))):
            if size > SORT_BYTES and row[0] != held[-1][0]:
                yield decide(held)
                held, size = [], 0
            held.append(row)
            size += len(row[1])
    if held:
        yield decide(held)


def decide(rows: list[tuple]) -> pa.RecordBatch:
    """code, piece and runs (first and last start, smallest id) of (code, piece, smallest id, largest id) rows.

    Runs that no document of the stretch can lose by, as none has a larger id, are left out. A group of
    one stretch is one run and needs no order.
    """
    code, low, high = (np.fromiter((r[k] for r in rows), np.int64, len(rows)) for k in (0, 2, 3))
    pieces = pa.array([r[1] for r in rows], pa.binary())
    length = np.diff(np.frombuffer(pieces.buffers()[1], np.int32)[: len(rows) + 1]).astype(np.int64)
    change = code[1:] != code[:-1]
    alone = np.r_[True, change] & np.r_[change, True]
    loses = low[alone] < high[alone]
    fields = [pa.array(np.zeros(loses.sum(), np.int32)), pa.array((length[alone] - WIDTH)[loses], pa.int32()), pa.array(low[alone][loses])]
    runs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(loses)], pa.int32()), pa.StructArray.from_arrays(fields, ["first", "last", "low"]))
    done = pa.RecordBatch.from_arrays([pa.array(code[alone]), pieces.filter(pa.array(alone)), runs.cast(RUNS)], names=["code", "piece", "runs"])
    if alone.all():
        return done
    pieces = pieces.filter(pa.array(~alone))
    code, low, high, length = (x[~alone] for x in (code, low, high, length))
    ends = np.flatnonzero(np.r_[np.diff(code) != 0, True])  # the last text of each group
    mark = np.ones(len(code), np.int64)
    mark[ends] = 0
    stop = np.cumsum(length + 1)
    begin = stop - length - 1
    symbols = np.empty(stop[-1], np.int64)
    symbols[ranges(begin, length)] = np.frombuffer(pieces.buffers()[2], np.uint8)[: length.sum()].astype(np.int64) + 2
    symbols[stop - 1] = mark  # 1 parts texts, 0 ends a group
    order = suffix_array(symbols, np.r_[0, stop[ends]])
    text = np.repeat(np.arange(len(code)), length + 1)
    order = order[stop[text[order]] - 1 - order >= WIDTH]
    same = code[text[order][1:]] == code[text[order][:-1]]
    near = np.flatnonzero(same)
    strings = np.lib.stride_tricks.sliding_window_view(symbols.astype(np.uint16), WIDTH)
    for k in range(0, len(near), 1 << 15):
        part = near[k : k + (1 << 15)]
        same[part] = (strings[order[part]] == strings[order[part + 1]]).all(axis=1)
    run = np.flatnonzero(np.r_[True, ~same])
    least = np.repeat(np.minimum.reduceat(low[text[order]], run), np.diff(np.r_[run, len(order)]))
    by = np.argsort(order)
    order, least = order[by], least[by]
    owner = text[order]
    cuts = np.flatnonzero(np.r_[True, (np.diff(owner) != 0) | (np.diff(least) != 0)])
    lasts = np.r_[cuts[1:], len(order)] - 1
    needed = least[cuts] < high[owner[cuts]]
    cuts, lasts = cuts[needed], lasts[needed]
    fields = [pa.array(order[cuts] - begin[owner[cuts]], pa.int32()), pa.array(order[lasts] - begin[owner[cuts]], pa.int32()), pa.array(least[cuts])]
    runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[cuts], np.arange(len(code) + 1)), pa.int32()), pa.StructArray.from_arrays(fields, ["first", "last", "low"]))
    several = pa.RecordBatch.from_arrays([pa.array(code), pieces, runs.cast(RUNS)], names=["code", "piece", "runs"])
    return pa.concat_batches([done, several])


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans united where they overlap or touch, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, gone, counts, digests, removed = [], [], [], [], []
        for text, spans in zip(texts(batch.column("text")), batch.column("spans").to_pylist()):
            found, kept, at = merge([(s["a"], s["b"]) for s in spans or []]), hashlib.sha256(), 0
            for a, b in found:
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            sizes.append(len(text))
            gone.append(sum(b - a for a, b in found))
            counts.append(len(found))
            digests.append(kept.hexdigest())
            removed.append([{"start": a, "end": b} for a, b in found])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests), pa.array(removed, kind)], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_texts: int = GROUP_TEXTS) -> DataFrame:
    """One row per input row: ``id_col``, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges removed)."""
    spark = docs.sparkSession
    bound_batches(spark, TABLE_ROWS)
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(4 * HASH_BYTES))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    long = rows.where(F.octet_length("text") >= WIDTH)

    # whole copies: all goes from any but the smallest id, so only that one is searched
    known = long.select("id", "mark", F.octet_length("text").alias("b"), F.unhex(F.sha2("text", 256)).alias("digest"))
    least = known.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    copies = cut(known.join(least, "digest").where("id > least").select("id", "mark", F.lit(0).alias("a"), "b").distinct(), "suffix-copies")
    left = long.select("id", "mark", "text").join(copies.select("id", "mark"), ["id", "mark"], "left_anti")
    chunks = left.mapInArrow(tidy(_pack), "ids array<long>, marks array<long>, texts array<binary>")
    chunks = cut(chunks.select(F.monotonically_increasing_id().alias("chunk"), "*"), "suffix-chunks", "zstd")
    forget_shuffles(spark)

    # anchors that several documents have: an anchor travels once for each chunk, as hash and tag, many in one row
    parts = min(max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), chunks.count() // PART_CHUNKS), (1 << 16) - 1)
    tags = chunks.select("chunk", "texts").mapInArrow(tidy(lambda batches: _packed(batches, parts)), "part int, codes binary, tags binary")
    shared = cut(tags.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(_unpacked), "chunk long, code long"), "suffix-shared")
    forget_shuffles(spark)
    wanted = shared.groupBy("chunk").agg(F.collect_list("code").alias("codes"))
    pieces = cut(chunks.join(wanted, "chunk").select("ids", "marks", "texts", "codes").mapInArrow(tidy(_pieces), f"code long, piece binary, low long, high long, places {PLACES}"), "suffix-pieces", "zstd")
    release(spark, chunks, shared)
    forget_shuffles(spark)

    distinct = cut(pieces.groupBy("code", "piece").agg(F.min("low").alias("low"), F.max("high").alias("high")), "suffix-distinct")
    big = cut(distinct.groupBy("code").count().where(F.col("count") > group_texts).select("code"), "suffix-big")
    starts = F.explode(F.sequence(F.lit(0), F.length("piece") - WIDTH)).alias("k")
    string = F.expr(f"substring(piece, k + 1, {WIDTH})").alias("piece")
    refiled = distinct.join(big, "code").select("piece", "low", "high", starts).select(string, "low", "high").groupBy("piece").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    groups = distinct.join(big, "code", "left_anti").select("code", "piece", "low", "high").union(refiled.select(F.xxhash64("piece"), "piece", "low", "high"))
    verdict = groups.repartition("code").sortWithinPartitions("code").mapInArrow(tidy(_owners), "code long, piece binary, runs array<struct<first int, last int, low long>>")
    # 128 bits stand for a stretch on the way back to its places
    name = [F.xxhash64("piece").alias("h"), F.xxhash64(F.lit(WIDTH), "piece").alias("g")]
    verdict = cut(verdict.where(F.size("runs") > 0).select(*name, "runs"), "suffix-runs")
    release(spark, distinct)
    forget_shuffles(spark)
    places = pieces.join(big, "code", "left_anti").select(*name, "places", F.lit(0).alias("k"))
    single = pieces.join(big, "code").select("piece", "places", starts).select(string, "places", "k")
    runs = places.union(single.select(*name, "places", "k")).join(verdict, ["h", "g"]).select("runs", "k", F.explode("places").alias("p")).select("p.id", "p.mark", (F.col("p.at") + F.col("k")).alias("at"), F.explode("runs").alias("r")).where("r.low < id")
    spans = runs.select("id", "mark", (F.col("at") + F.col("r.first")).alias("a"), (F.col("at") + F.col("r.last") + WIDTH).alias("b")).union(copies)
    spans = cut(spans.groupBy("id", "mark").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "suffix-spans")
    release(spark, pieces, verdict, big, copies)
    forget_shuffles(spark)
    bound_batches(spark)
    spark.conf.set(BATCH_BYTES, before)
    out = rows.join(spans, ["id", "mark"], "left").select("doc", "text", "spans").mapInArrow(tidy(_cut_out), "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start int, end int>>")
    return out.withColumnRenamed("doc", id_col)
