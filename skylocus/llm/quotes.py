"""Chat formatting by quotation linking.

A line's quote level is the number of ``>`` marks that it begins with (blanks between them allowed). A
message's own text is its lines of level 0; lines of one level in a row are a quoted passage. Passages
are normalised (lower case, runs of white space to one blank, trimmed) and hashed. They are joined to
the own lines and the whole own text of earlier messages of the same conversation: a passage links to
the latest message that holds it, whole, as one of its lines, or, if it has several lines, as lines in the
same order, with or without others between them; if none does, to the latest that holds more than half of
its lines in order. Empty lines do not count. A message replies to the link of its
passage of least level, the latest if several. Conversations come out in reply order - a message quotes
only earlier turns, so by turn - and without the quotes.

Cases: null text is empty; an empty passage links to nothing; nothing links to itself or to a message
without conv_id or turn. Messages that repeat (conv_id, turn) each give a row, and share their links.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, texts

_LEVEL = re.compile(r"[ \t]*((?:>[ \t]*)+)")
_SPACE = re.compile(r"\s+")


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """Own text, and the quoted passages with their levels."""
    own, passages = [], []
    last = 0
    for line in text.split("\n"):
        mark = _LEVEL.match(line)
        level = mark.group(1).count(">") if mark else 0
        rest = line[mark.end() :] if mark else line
        if not level:
            own.append(rest)
        elif level == last:
            passages[-1][1].append(rest)
        else:
            passages.append((level, [rest]))
        last = level
    return "\n".join(own).strip(), [(n, "\n".join(p)) for n, p in passages]


def normal(passage: str) -> str:
    return _SPACE.sub(" ", passage).strip().lower()


def key(passage: str) -> str | None:
    said = normal(passage)
    return xxhash.xxh3_128_hexdigest(said.encode()) if said else None


def keys(passage: str) -> list[str]:
    """The keys of its lines in order, without empty ones."""
    return [k for line in passage.split("\n") if (k := key(line))]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, levels, quoted, lines, runs, said, full = [], [], [], [], [], [], []
        for raw in texts(batch.column("text")):
            body, passages = parse(raw.decode("utf-8", "replace"))
            keyed = [(n, k, keys(p)) for n, p in passages if (k := key(p))]
            own.append(body)
            levels.append([n for n, _, _ in keyed])
            quoted.append([k for _, k, _ in keyed])
            lines.append([run if len(run) > 1 else [] for _, _, run in keyed])
            runs.append([xxhash.xxh3_128_hexdigest("".join(run)) if len(run) > 1 else None for _, _, run in keyed])
            said.append(keys(body))
            full.append(key(body))
        listed = pa.list_(pa.string())
        kinds = [pa.string(), pa.list_(pa.int32()), listed, pa.list_(listed), listed, listed, pa.string()]
        arrays = [pa.array(c, k) for c, k in zip((own, levels, quoted, lines, runs, said, full), kinds)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "role")), *arrays], names=["conv_id", "turn", "role", "own", "levels", "quoted", "lines", "runs", "said", "full"])


def in_order(pairs: list[tuple[int, int]]) -> int:
    """Most of the pairs (line of the passage, line of the message) that rise in both."""
    ends: list[int] = []
    for _, at in sorted(pairs, key=lambda p: (p[0], -p[1])):
        k = bisect_left(ends, at)
        ends[k : k + 1] = [at]
    return len(ends)


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages that hold more than half of a passage's lines in order, and whether they hold all."""
    for batch in batches:
        most = [in_order([(p["i"], p["pos"]) for p in pairs]) for pairs in batch.column("pairs").to_pylist()]
        lines = batch.column("lines").to_pylist()
        out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "run", "turn")), pa.array([m == n for m, n in zip(most, lines)], pa.bool_())], names=["conv_id", "run", "turn", "whole"])
        yield out.filter(pa.array([2 * m > n for m, n in zip(most, lines)], pa.bool_()))


def _by_lines(parsed: DataFrame, asked: DataFrame) -> DataFrame:
    """conv_id, turn, level, key, whole, to: links of passages of several lines to the latest earlier messages that hold all and most of their lines.

    A passage that is quoted many times in a conversation is compared with its messages once.
    """
    passages = asked.select("conv_id", "run", "lines").dropDuplicates(["conv_id", "run"])
    wanted = passages.select("conv_id", "run", F.size("lines").alias("n"), F.posexplode("lines").alias("i", "line"))
    there = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.xxhash64("said").alias("row"), F.posexplode("said").alias("pos", "line"))
    met = wanted.join(there, ["conv_id", "line"]).groupBy("conv_id", "run", "turn", "row").agg(F.first("n").alias("lines"), F.count_distinct("i").alias("seen"), F.collect_list(F.struct("i", "pos")).alias("pairs"))
    held = met.where("2 * seen > lines").select("conv_id", "run", "turn", "lines", "pairs").mapInArrow(_ordered, "conv_id long, run string, turn long, whole boolean")
    events = held.select("conv_id", "run", "turn", "whole", F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("key"))
    events = events.unionByName(asked.select("conv_id", "run", "turn", F.lit(None).cast("boolean").alias("whole"), "level", "key"))
    before = Window.partitionBy("conv_id", "run").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    to = F.max(F.when(F.col("whole").isNotNull(), F.struct("whole", "turn"))).over(before)
    return events.withColumn("at", to).where("level is not null and at is not null").select("conv_id", "turn", "level", "key", F.col("at.whole").alias("whole"), F.col("at.turn").alias("to"))


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text without quotes, n_quotes, max_level, n_linked, reply_to (a turn or null), in reply order.

    Scale: only the keys of quoted passages and of messages in conversations are joined, by conversation
    and key together, so that a long conversation is spread over as many tasks as it has passages; keys of
    messages that nobody quotes are dropped before they are grouped.
    """
    bound_batches(messages.sparkSession)
    rows = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    parsed = rows.mapInArrow(_parsed, "conv_id long, turn long, role string, own string, levels array<int>, quoted array<string>, lines array<array<string>>, runs array<string>, said array<string>, full string")
    parsed = cut(parsed, "quotes-parsed")
    quotes = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(F.arrays_zip("levels", "quoted", "runs", "lines")).alias("q"))
    quotes = quotes.select("conv_id", "turn", F.col("q.levels").alias("level"), F.col("q.quoted").alias("key"), F.col("q.runs").alias("run"), F.col("q.lines").alias("lines"))
    asked = quotes.select("conv_id", "turn", "level", "key").distinct()
    wanted = asked.select("conv_id", "key").distinct()
    there = parsed.select("conv_id", F.col("turn").alias("at"), F.explode(F.array_union("said", F.array("full"))).alias("key")).where("conv_id is not null and at is not null")
    there = there.join(wanted, ["conv_id", "key"], "left_semi").distinct()
    # pairs of a quoting and a holding turn of one passage; the latest earlier holder by a running maximum instead of a join of the two
    events = there.select("conv_id", "key", F.col("at").alias("turn"), F.lit(None).cast("int").alias("level")).unionByName(asked)
    before = Window.partitionBy("conv_id", "key").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    linked = events.withColumn("to", F.max(F.when(F.col("level").isNull(), F.col("turn"))).over(before)).where("level is not null and to is not null")
    linked = linked.select("conv_id", "turn", "level", "key", F.lit(True).alias("whole"), "to")
    several = quotes.where("run is not null")
    if not several.isEmpty():
        linked = linked.unionByName(_by_lines(parsed, several.dropDuplicates(["conv_id", "turn", "level", "key", "run"])))
        linked = linked.groupBy("conv_id", "turn", "level", "key").agg(F.max(F.struct("whole", "to")).alias("at")).select("conv_id", "turn", "level", F.col("at.to").alias("to"))
    best = linked.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"), F.max(F.struct((-F.col("level")).alias("near"), F.col("to").alias("to"))).alias("best"))
    out = parsed.join(best, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", F.col("own").alias("text"), F.size("quoted").alias("n_quotes"),
        F.coalesce(F.array_max("levels"), F.lit(0)).alias("max_level"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("best.to").alias("reply_to"),
    )
    return out.orderBy("conv_id", "turn")
