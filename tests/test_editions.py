"""Moved anchors, compared versions and divisions against small cases and plain restatements."""

import random
import re

from pyspark.sql import functions as F

from quirework.functions import text as tx
from quirework.operators import compare, refind, sequences

STORED = "id int, doc int, start_idx int, start_off int, end_idx int, end_off int, exact string, prefix string, suffix string"
NODE = "doc int, idx int, text string"


def test_common_ends(spark):
    pairs = [("abc", "abd", 2, 0), ("", "a", 0, 0), ("", "", 0, 0), ("aXc", "bXc", 0, 2), ("same", "same", 4, 4), ("é漢", "é漢字", 2, 0), ("xyz", "z", 0, 1)]
    df = spark.createDataFrame(pairs, "a string, b string, p int, s int")
    assert [tuple(r) for r in df.select(tx.common_prefix(F.col("a"), F.col("b")), tx.common_suffix(F.col("a"), F.col("b"))).collect()] == [p[2:] for p in pairs]


def test_valid_repaired_and_unattached(spark):
    lines = [(1, 0, "Concluding “Stay. Not yet.”"), (1, 1, "The hour’s now come."), (1, 2, "The very minute bids thee ope thine ear.")]
    anchors = [
        (1, 1, 1, 4, 1, 10, "hour’s", "The ", " now come."),
        (2, 1, 0, 0, 0, 6, "hour’s", "The ", " now come."),
        (3, 1, 0, 0, 0, 3, "no such words anywhere", "", ""),
        (4, 1, 0, 0, 0, 3, "th", "", ""),
        (5, 1, 0, 2, 1, 1, "“Stay. Not yet.”\nThe", "Concluding ", " hour’s now come."),
        (6, 1, 0, 0, 0, 2, "The", None, " very"),
        (7, 1, 9, 0, 9, 2, "", None, None),
        (8, 1, 0, 0, 0, 9, "\n", "", ""),
        (9, 2, 0, 0, 0, 3, "The", "", ""),
        (10, 1, 2, 0, 1, 3, "The", "", " hour"),
    ]
    got = {r.id: tuple(r)[2:] for r in refind.resolved(spark.createDataFrame(anchors, STORED), spark.createDataFrame(lines, NODE), "doc").collect()}
    none = ("unattached", None, None, None, None)
    assert got == {1: ("valid", 1, 4, 1, 10), 2: ("repaired", 1, 4, 1, 10), 3: none, 4: none, 5: ("repaired", 0, 11, 1, 3), 6: ("repaired", 2, 0, 2, 3), 7: none, 8: none, 9: none, 10: ("repaired", 1, 0, 1, 3)}


def plainly(lines, a):
    """The span that an anchor has by a search of the whole text."""
    flat, begins, at = "\n".join(lines), [], 0
    for line in lines:
        begins.append(at)
        at += len(line) + 1
    _, _, si, so, ei, eo, exact, prefix, suffix = a
    if si < len(lines) and ei < len(lines) and si <= ei:
        parts = lines[si : ei + 1]
        parts[-1] = parts[-1][:eo]
        parts[0] = parts[0][so:]
        if "\n".join(parts) == exact:
            return ("valid", si, so, ei, eo)
    found = []
    for p in range(len(flat)):
        if flat.startswith(exact, p):
            before, after = flat[:p], flat[p + len(exact) :]
            n = next((k for k in range(len(prefix) + 1) if k == len(prefix) or k == len(before) or before[-1 - k] != prefix[-1 - k]), 0)
            m = next((k for k in range(len(suffix) + 1) if k == len(suffix) or k == len(after) or after[k] != suffix[k]), 0)
            found.append((n + m, p))
    best = sorted(found, reverse=True)[:2]
    if not best or len(best) == 2 and best[0][0] == best[1][0]:
        return ("unattached", None, None, None, None)
    place = lambda p: max((i, p - b) for i, b in enumerate(begins) if b <= p)
    return ("repaired", *place(best[0][1]), *place(best[0][1] + len(exact)))


def test_lost_anchors_against_a_search_of_the_whole_text(spark):
    """Texts of few letters, so that quotations occur often, overlap and cross lines, some of them empty."""
    draw = random.Random(9)
    texts = {d: ["".join(draw.choice("ab ") for _ in range(draw.choice((0, 1, 3, 20, 60)))) for _ in range(12)] for d in range(6)}
    anchors = []
    for n in range(240):
        d = draw.randrange(6)
        flat = "\n".join(texts[d])
        p = draw.randrange(len(flat) - 1)
        exact = flat[p : p + draw.choice((1, 2, 3, 5, 9, 16, 40))]
        if not exact.strip("\n"):
            continue
        prefix = flat[max(0, p - draw.choice((0, 2, 8))) : p].split("\n")[-1]
        suffix = flat[p + len(exact) : p + len(exact) + draw.choice((0, 2, 8))].split("\n")[0]
        si, ei = sorted((draw.randrange(12), draw.randrange(12)))
        anchors.append((n, d, si, draw.randrange(4), ei, draw.randrange(9), exact, prefix, suffix))
    nodes = [(d, i, t) for d, ts in texts.items() for i, t in enumerate(ts)]
    got = {r.id: tuple(r)[2:] for r in refind.resolved(spark.createDataFrame(anchors, STORED), spark.createDataFrame(nodes, NODE), "doc").collect()}
    assert got == {a[0]: plainly(texts[a[1]], a) for a in anchors}
    assert len({v[0] for v in got.values()}) >= 2


def test_no_anchors_and_no_nodes(spark):
    a, n = spark.createDataFrame([(1, 1, 0, 0, 0, 3, "abc", "", "")], STORED), spark.createDataFrame([(1, 0, None), (1, 1, "xabc")], NODE)
    assert refind.resolved(a.limit(0), n, "doc").collect() == []
    assert refind.resolved(a, n.limit(0), "doc").first().status == "unattached"
    assert tuple(refind.resolved(a, n, "doc").first())[2:] == ("repaired", 1, 1, 1, 4)


def test_unattached_notes_are_told_apart(spark):
    notes = spark.createDataFrame([(1, "v", 3, 0, 0, 0, 1), (2, "v", 1, 0, 0, 0, 1), (3, "v", 2, 0, 0, 0, 1)], "id int, version string, made int, start_idx int, start_off int, end_idx int, end_off int")
    told = spark.createDataFrame([(1, "valid", 0, 0, 0, 1), (2, "repaired", 4, 0, 4, 1), (3, "unattached", None, None, None, None)], "id int, status string, start_idx int, start_off int, end_idx int, end_off int")
    shown, left = refind.attached(notes, told, "made")
    assert sorted((r.id, r.start_idx, r.place) for r in shown.collect()) == [(1, 0, 2), (2, 4, 1)]
    assert [r.id for r in left.collect()] == [3]


def test_positions_in_the_whole_text(spark):
    nodes = spark.createDataFrame([(1, 0, "abc", 0), (1, 1, None, 4), (1, 2, "x" * 3000, 5)], "doc int, idx int, text string, begin int")
    points = spark.createDataFrame([(p, 1, p) for p in (-1, 0, 3, 4, 5, 1029, 3005, 3006)], "point int, doc int, at int")
    got = {r.point: (r.idx, r.off) for r in refind.positions(points, nodes, "doc").collect()}
    assert got == {0: (0, 0), 3: (0, 3), 4: (1, 0), 5: (2, 0), 1029: (2, 1024), 3005: (2, 3000)}


def compared(left, right, left_entries, right_entries):
    """Rows of two versions, with loops over their nodes."""

    def units(nodes, entries):
        if entries is None:
            return [([i], [i]) for i in nodes]
        of = {}
        for k, (orig, _) in enumerate(entries):
            of.update(dict.fromkeys(orig, k))
        out, before = [], None
        for i in nodes:
            if out and i in of and of[i] == before:
                out[-1][0].append(i)
            else:
                out.append(([i], entries[of[i]][1] if i in of else []))
            before = of.get(i)
        return out

    met = {}
    for nodes, modern in units(right, right_entries):
        for m in modern:
            met.setdefault(m, []).extend(nodes)
    used, out = set(), []
    for nodes, modern in units(left, left_entries):
        mine = sorted({i for m in modern for i in met.get(m, ())} - used)
        used.update(mine)
        out.append((nodes, mine))
    row_of, last, free = {i: n for n, (_, r) in enumerate(out) for i in r}, -1, {}
    for i in right:
        if i in row_of:
            last = row_of[i]
        else:
            runs = free.setdefault(last, [])
            if runs and runs[-1][-1] == i - 1:
                runs[-1].append(i)
            else:
                runs.append([i])
    laid = [([], run) for run in free.get(-1, [])]
    for n, row in enumerate(out):
        laid += [row, *(([], run) for run in free.get(n, []))]
    furthest, told = -1, []
    for nodes, mine in laid:
        told.append((nodes, mine, bool(mine) and mine[0] < furthest))
        furthest = max([furthest, *mine[-1:]])
    return told


def test_rows_of_versions_against_plain_loops(spark):
    draw = random.Random(3)
    cases = {}
    for d in range(40):
        n, m, k = (draw.randrange(0, 9) for _ in range(3))
        entries = lambda size: [(sorted(draw.sample(range(size), min(size, draw.randrange(0, 4)))), sorted(draw.sample(range(k), min(k, draw.randrange(0, 3))))) for _ in range(draw.randrange(0, 5))]
        cases[d] = (n, m, entries(n), entries(m))
    node = lambda at: spark.createDataFrame([(d, i, "x") for d, c in cases.items() for i in range(c[at])], "doc int, idx int, text string")
    table = lambda at: spark.createDataFrame([(d, e, o, c or None) for d, case in cases.items() for e, (o, c) in enumerate(case[at])], "doc int, entry int, orig array<int>, modern array<int>")
    for le, re_ in ((2, 3), (None, 3), (2, None)):
        got = {}
        for r in compare.rows(node(0), node(1), "doc", le and table(le), re_ and table(re_)).orderBy("doc", "place").collect():
            got.setdefault(r.doc, []).append((r.left, r.right, r.moved))
        want = {d: compared(range(c[0]), range(c[1]), c[le] if le else None, c[re_] if re_ else None) for d, c in cases.items()}
        assert got == {d: w for d, w in want.items() if w}
    assert compare.rows(node(0).limit(0), node(1).limit(0), "doc").collect() == []


def words_lacking(left, right, key):
    """The words of each side that a longest common subsequence leaves out, right ones first where both ways are as long."""
    split = lambda t: [(m.start(), m.end(), key(m[0])) for m in re.finditer(r"[^\s—–-]+", t) if key(m[0])]
    a, b = split(left), split(right)
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][2] == b[j][2] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i][2] == b[j][2]:
            i, j = i + 1, j + 1
        elif j < len(b) and (i == len(a) or best[i][j + 1] >= best[i + 1][j]):
            out.append(("right", *b[j][:2]))
            j += 1
        else:
            out.append(("left", *a[i][:2]))
            i += 1
    return sorted(out)


def diff(spark, pairs, exact):
    rows = spark.createDataFrame([(d, 1, [0], [0]) for d in range(len(pairs))], "doc int, place int, left array<int>, right array<int>")
    side = lambda k: spark.createDataFrame([(d, 0, p[k]) for d, p in enumerate(pairs)], "doc int, idx int, text string")
    out = [[] for _ in pairs]
    for r in compare.differences(rows, side(0), side(1), "doc", exact).collect():
        out[r.doc].append((r.side, r.start, r.end))
    return [sorted(x) for x in out]


def test_word_differences(spark):
    smot = ("He smot the sleaded pollax on the ice.", "He smot the sledded Pollax on the Ice.")
    loose, plain, none = diff(spark, [smot, ("Stand and vnfolde", "Stand & vnfold"), (None, "")], False)
    assert [smot[s == "right"][a:b] for s, a, b in loose] == ["sleaded", "sledded"] and plain == none == []
    (exact,) = diff(spark, [smot], True)
    assert [smot[0][a:b] for s, a, b in exact if s == "left"] == ["sleaded", "pollax", "ice."]
    draw = random.Random(8)
    pairs = [tuple(" ".join(draw.choice(["an", "b,", "c", "—", "D", "&", "and"]) for _ in range(draw.randrange(0, 9))) for _ in range(2)) for _ in range(60)]
    strip = lambda w: "and" if w == "&" else re.sub(r"^\W+|\W+$", "", w)
    assert diff(spark, pairs, True) == [words_lacking(*p, strip) for p in pairs]


def test_differences_lie_in_their_nodes(spark):
    nodes = spark.createDataFrame([(1, 0, "one two"), (1, 1, "three—four")], "doc int, idx int, text string")
    other = spark.createDataFrame([(1, 0, "one"), (1, 1, "four, five")], "doc int, idx int, text string")
    rows = spark.createDataFrame([(1, 1, [0, 1], [0, 1])], "doc int, place int, left array<int>, right array<int>")
    got = sorted(tuple(r)[2:] for r in compare.differences(rows, nodes, other, "doc").collect())
    assert got == [("left", 0, 4, 7), ("left", 1, 0, 5), ("right", 1, 6, 10)]


def test_ranges_by_node(spark):
    draw = random.Random(6)
    lines = {d: ["x" * draw.choice((0, 1, 5, 700)) for _ in range(8)] for d in range(4)}
    ranges = [(d, *sorted((draw.randrange(-3, 2500), draw.randrange(0, 2500)))) for d in range(4) for _ in range(30)]
    want = []
    for d, ts in lines.items():
        at = 0
        for i, t in enumerate(ts):
            want += [(d, i, max(a - at, 0), min(b - at, len(t))) for e, a, b in ranges if e == d and min(b - at, len(t)) > max(a - at, 0)]
            at += len(t) + 1
    nodes = spark.createDataFrame([(d, i, t) for d, ts in lines.items() for i, t in enumerate(ts)], "doc int, idx int, text string")
    got = compare.by_node(spark.createDataFrame(ranges, "doc int, start int, end int"), nodes, "doc")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_common_subsequence_at_any_block_size():
    """Pairs and ties of a whole table, however few rows are kept."""
    draw = random.Random(1)
    for _ in range(400):
        letters = "abcdef"[: draw.choice((2, 3, 6))]
        a, b = ([draw.choice(letters) for _ in range(draw.randrange(14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in reversed(range(len(a))):
            for j in reversed(range(len(b))):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        want, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                want.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
        assert all(sequences.common(a, b, kept) == want for kept in (1, 3, 1024))


def test_every_ampersand_is_a_word(spark):
    df = spark.createDataFrame([("you&me &c. & so",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.keys(F.col("t"))).collect()] == [["iou", "and", "m", "and", "c", "and", "so"], []]


def test_words_are_not_moved_one_by_one(spark):
    """Spans are told where a node is, and differences move nodes whole; words were dealt out and shuffled before."""
    nodes = spark.createDataFrame([(1, 0, "one  two—three"), (1, 1, None), (2, 0, " ä b")], "doc int, idx int, text string")
    spans = compare.word_spans(nodes, "doc")
    assert "Exchange" not in spans._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in spans.collect()) == [(1, 0, 0, 0, 3, "one"), (1, 0, 2, 5, 8, "two"), (1, 0, 4, 9, 14, "three"), (2, 0, 1, 1, 2, "ä"), (2, 0, 3, 3, 4, "b")]
    rows = spark.createDataFrame([(1, 1, [0, 1], [0])], "doc int, place int, left array<int>, right array<int>")
    plan = compare.differences(rows, nodes, nodes, "doc")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
