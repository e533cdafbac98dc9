import textwrap
from collections import Counter

from skylocus.llm import licenses as op
from skylocus.llm.common import table


def brute(text, least=op.LEAST):
    """Every template against every unit."""
    out = {}
    lines = (text or "").split("\n")
    units = [op.words(x) for x in lines]
    if sum(map(bool, units)) > 1:
        units.append([w for u in units for w in u])
    for unit in units:
        best = None
        for name in sorted(op.TEMPLATES):
            for k, t in enumerate(op.TEMPLATES[name]):
                a, b = op.bigrams(op.words(t)), op.bigrams(unit)
                n = sum(a.values()) + sum(b.values())
                d = 2 * sum(min(a[g], b[g]) for g in a) / n if n else 0
                if d >= least and (best is None or d > best[0]):
                    best = (d, name, k)
        if best:
            d, name, k = best
            was = out.get(name, (0, 0, 0))
            out[name] = (d, k, was[2] + 1) if d > was[0] else (*was[:2], was[2] + 1)
    return out


def rows_of(i, text):
    return [(i, n, k, round(d, 9), c) for n, (d, k, c) in sorted(brute(text).items())] or [(i, None, None, None, 0)]


def test_matches_brute_force_on_the_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = sorted((tuple(r[:3]) + (r[3] and round(r[3], 9), r[4]) for r in op.scan(docs).collect()), key=repr)
    want = sorted((x for r in docs.collect() for x in rows_of(r.doc_id, r.text)), key=repr)
    assert got == want
    assert {"MIT", "GPL-3.0", "Apache-2.0", "CC-BY-NC-4.0"} <= {r[1] for r in got}


def test_cases(spark, make_docs):
    gpl = op.TEMPLATES["GPL-3.0"][1]
    rows = [(1, None), (2, ""), (3, "MIT"), (4, "released UNDER the mit licence!"), (5, "x " * 60_000), (6, f"a\n{gpl}\n{gpl.lower()}"), (6, "Released under the MIT License."), (None, "Licensed under CC BY 4.0")]
    rows.append((7, gpl.replace("Foundation, ", "Foundation,\n")))
    got = sorted((tuple(r[:3]) + (r[3] and round(r[3], 9), r[4]) for r in op.scan(make_docs(rows)).collect()), key=repr)
    assert got == sorted((x for i, t in rows for x in rows_of(i, t)), key=repr)
    assert op.scan(make_docs([])).count() == 0


def test_dice_counts_repeats():
    assert op.dice(Counter({"a": 2}), Counter({"a": 1})) == 2 / 3


def best_window(text, name, k):
    """The highest score of all windows of words with no fewer bigrams."""
    t, found = op.bigrams(op.words(op.TEMPLATES[name][k])), op.words(text)
    return max(op.dice(t, op.bigrams(found[x:y])) for x in range(len(found)) for y in range(x + t.total() + 1, min(len(found), x + 2 * t.total()) + 1))


def test_wrapped_and_embedded_notices(spark, make_docs):
    prose = [f"some other words number {i} that say nothing about terms" for i in range(12)]
    rows, want = [], {}
    for i, (name, k) in enumerate([("MIT", 1), ("GPL-3.0", 1), ("Apache-2.0", 2), ("BSD", 0), ("CC-BY-SA-4.0", 1), ("MIT", 0)]):
        notice = op.TEMPLATES[name][k].replace("free of charge", "free of any charge")
        wrapped = "\n".join([*prose, *textwrap.wrap(notice, 40), *prose])
        within = " ".join([*prose, notice, *prose])
        rows += [(2 * i, wrapped), (2 * i + 1, within)]
        want |= {2 * i + j: (name, k, round(best_window(text, name, k), 9)) for j, text in enumerate((wrapped, within))}
    found = [tuple(r) for r in op.scan(make_docs(rows)).collect()]
    assert {r[0]: (r[1], r[2], round(r[3], 9)) for r in found} == want and len(found) == len(rows)


def test_windows_do_not_overlap():
    scanner = op.Scanner(op.TEMPLATES, op.LEAST)
    gpl = op.TEMPLATES["GPL-3.0"][1]
    two = "a b c " + "\n".join(textwrap.wrap(gpl, 60)) + "\nd e f " + gpl.lower() + " g h i " * 30
    assert scanner.document(two) == {"GPL-3.0": (1.0, 1, 2)}
    assert scanner.document("words " * 50 + "permission is granted to any person " * 5) == {}


def test_wrapped_notice_with_words_missing():
    scanner = op.Scanner(op.TEMPLATES, op.LEAST)
    notice = op.words(op.TEMPLATES["MIT"][1])
    kept = notice[: round(len(notice) * 0.75)]
    n, s = len(kept) - 1, len(notice) - 1
    assert scanner.document("\n".join(["words before it"] * 9 + [*textwrap.wrap(" ".join(kept), 50), *["after it"] * 9])) == {"MIT": (2 * n / (n + s), 1, 1)}
    assert scanner.document("released under the mit licence") == {}
