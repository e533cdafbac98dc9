from collections import defaultdict

from pyspark.sql import functions as F
from skylocus.llm import quotes as op

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    parsed = [(c, t, r, *op.parse(x or "")) for c, t, r, x in rows]
    held = defaultdict(set)
    for c, t, _, own, _ in parsed:
        if c is not None and t is not None:
            for p in [own, *own.split("\n")]:
                if op.normal(p):
                    held[(c, t)].add(op.normal(p))
    asked = defaultdict(set)
    for c, t, _, _, quoted in parsed:
        if c is not None and t is not None:
            asked[(c, t)] |= {(n, op.normal(p)) for n, p in quoted if op.normal(p)}
    out = []
    for c, t, r, own, quoted in parsed:
        links = []
        for n, p in asked.get((c, t), ()):
            to = [u for (d, u), has in held.items() if d == c and u < t and p in has]
            if to:
                links.append((-n, max(to)))
        full = [n for n, p in quoted if op.normal(p)]
        out.append((c, t, r, own, len(full), max(full, default=0), len(links), max(links)[1] if links else None))
    return sorted(out, key=repr)


ROWS = [
    (1, 0, "user", "Hello there\nSecond line"),
    (1, 1, "assistant", "> hello   THERE\nHi."),
    (1, 2, "user", ">> Hello there\n> Hi.\nSo?"),
    (1, 3, "user", "> Hello there\n> Second line\nwhole"),
    (1, 4, "assistant", "> Second line\n"),
    (1, 5, "user", "Hello there"),
    (1, 6, "user", "> hello there\n>\n> So?\nafter"),
    (2, 0, "user", "> Hello there"),
    (2, 1, "user", None),
    (2, 1, "user", ""),
    (3, 0, "user", "> > deep\n>>> deeper\nx"),
    (3, 1, "user", "x"),
    (3, 2, "user", "> x\n> x"),
    (None, 1, "user", "> x"),
    (3, None, "user", "> x\nx"),
    (4, 0, None, "y" * 100_000),
    (4, 1, "user", "> " + "y" * 100_000),
    (4, 1, "user", "> " + "y" * 100_000),
]


def test_brute_force(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA).withColumn("key", F.lit(1)).withColumn("own", F.lit("clash")).repartition(3)
    got = [tuple(r) for r in op.link(frame).collect()]
    assert sorted(got, key=repr) == brute(ROWS)
    known = [(c, t) for c, t, *_ in got if c is not None and t is not None]
    assert known == sorted(known)


def test_expected_threads(spark):
    got = {(r.conv_id, r.turn): r.reply_to for r in op.link(spark.createDataFrame(ROWS, SCHEMA)).where("conv_id = 1").collect()}
    assert got == {(1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): 0, (1, 4): 0, (1, 5): None, (1, 6): None}


def test_empty(spark):
    assert op.link(spark.createDataFrame([], SCHEMA)).count() == 0


def test_some_lines_of_a_message(spark):
    rows = [
        (1, 0, "user", "One\nTwo\n\nThree\nFour\nFive"),
        (1, 1, "user", "Two\nother"),
        (1, 2, "user", "> two\n> THREE\nlines 2 and 3"),
        (1, 3, "user", "> Two\n> [...]\n> Five\nmost, trimmed"),
        (1, 4, "user", "> Five\n> One\nnot in order"),
        (1, 5, "user", "> Two\n>\n> Five\nwith a gap"),
        (1, 6, "user", "Two\nThree"),
        (1, 7, "user", "> two\n> three\nthe latest"),
        (1, 8, "user", "> Two\n> Five\n>> Two\n>> Three\nleast level first"),
        (1, 9, "user", "> One\n> Two\n> other\nmost in two messages"),
        (2, 0, "user", "> Two\n> Three\nother conversation"),
        (3, 0, "user", "a"),
        (3, 0, "user", "b"),
        (3, 1, "user", "> a\n> b\ntwo rows of one turn"),
        (4, 0, "user", "x\ny x"),
        (4, 1, "user", "> x\n> y\n> x\nsame words, other lines"),
    ]
    got = {(r.conv_id, r.turn): (r.n_linked, r.reply_to) for r in op.link(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    want = {(1, 2): (1, 0), (1, 3): (1, 0), (1, 5): (1, 0), (1, 7): (1, 6), (1, 8): (2, 0), (1, 9): (1, 1), (4, 1): (1, 0)}
    assert got == {(c, t): want.get((c, t), (0, None)) for c, t, *_ in rows}


def test_in_order():
    assert op.in_order([]) == 0 and op.in_order([(0, 3), (1, 1), (1, 4), (2, 2)]) == 2 and op.in_order([(0, 5), (0, 6)]) == 1
