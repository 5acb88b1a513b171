"""Anchors, overlays and alignments against small cases and plain restatements."""

from collections import defaultdict

from pyspark.sql import functions as F

from quirework.functions import text as tx
from quirework.operators import anchors, cuts
from quirework.plans import queries, spans

SF = "/root/testdata/sf0.001"
ANCHOR = "id int, doc int, start_idx int, start_off int, end_idx int, end_off int"
NODE = "doc int, idx int, text string"


def test_spans_snap_to_words_across_nodes(spark):
    nodes = spark.createDataFrame([(1, 0, "Now, fair Hippolyta,"), (1, 1, " -- our"), (1, 2, None), (1, 3, "nuptial hour")], NODE)
    spans_ = [(1, 1, 0, 7, 0, 12), (2, 1, 0, 19, 3, 2), (3, 1, 0, 3, 0, 4), (4, 1, 0, 18, 1, 5), (5, 1, 0, 0, 9, 1), (6, 1, 0, 19, 1, 3)]
    got = {r.id: tuple(r)[1:] for r in anchors.snapped(spark.createDataFrame(spans_, ANCHOR), nodes, "doc").collect()}
    # widening comes first, so the comma alone (3) is all that is left to trim; 5 names a node that is not there
    assert got == {1: (0, 5, 0, 19), 2: (1, 4, 3, 7), 4: (0, 10, 1, 7)}


def test_positions_are_held_from_start_up_to_end(spark):
    df = spark.createDataFrame([(1, 5, 2, 3)], "start_idx int, start_off int, end_idx int, end_off int")
    at = [(1, 4), (1, 5), (2, 2), (2, 3)]
    assert list(df.select(*[anchors.holds(F.lit(i), F.lit(o)).alias(f"h{n}") for n, (i, o) in enumerate(at)]).first()) == [False, True, True, False]
    assert df.select(anchors.span_key()).first()[0] == "1:5-2:3"


def test_overlay_of_an_empty_text(spark):
    ops = spark.createDataFrame([(1, "hide", 1, 0, 0, 0, 3, None, None, None), (2, "insert", 1, None, None, None, None, 0, 1, "Exit."), (3, "insert", 1, None, None, None, None, 7, 1, "lost")], "id int, type string, doc int, start_idx int, start_off int, end_idx int, end_off int, after int, n int, insert_text string")
    nodes = spark.createDataFrame([(1, 0, "abc")], NODE)
    shown = cuts.displayed(ops, nodes, "doc")
    assert [tuple(r) for r in shown.collect()] == [(1, 0, 1, "Exit.", "2")]
    assert [tuple(r) for r in cuts.landing(shown, nodes, "doc").collect()] == [(1, 0, None)]
    assert cuts.displayed(ops.limit(0), nodes.limit(0), "doc").count() == 0


def restated(orig, modern):
    """Entries of two lists of lines of keys: a longest common subsequence, then lines that its pairs connect."""
    a, b = ([(i, w) for i, ws in enumerate(side) for w in ws] for side in (orig, modern))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = 1 + best[i + 1][j + 1] if a[i][1] == b[j][1] else max(best[i + 1][j], best[i][j + 1])
    near, i, j = defaultdict(set), 0, 0
    while i < len(a) and j < len(b):
        if a[i][1] == b[j][1]:
            near["o", a[i][0]].add(("m", b[j][0]))
            near["m", b[j][0]].add(("o", a[i][0]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    out, left = set(), {("o", n) for n in range(len(orig))} | {("m", n) for n in range(len(modern))}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            todo += near[x] - group
        left -= group
        out.add(tuple(tuple(sorted(n for s, n in group if s == side)) for side in "om"))
    return out


def test_alignments_against_a_restatement(spark):
    lines = lambda t, k: {r[0]: [list(x) for x in r[1]] for r in spark.read.parquet(f"{SF}/{t}.parquet").select(k, F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), tx.keys)).collect()}
    docs, items = lines("documents", "doc_id"), lines("benchmark", "item_id")
    got = defaultdict(set)
    for r in spans.QUERIES["alignments"](spark, SF).collect():
        got[r.doc_id, r.item_id].add((tuple(r.orig), tuple(r.modern)))
    assert got.keys() == {(r.doc_id, r.item_id) for r in queries.QUERIES["landmarks"](spark, SF).collect()} and got
    for doc, item in got:
        assert got[doc, item] == restated(items[item], docs[doc])
