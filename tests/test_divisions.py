"""Divisions supplied from an aligned version, against small cases and plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quirework.operators import divisions

BLOCK = "doc int, turn int, n int, words array<string>, entrance boolean"
SCENE = "doc int, turn int, act int, kind string, no int, words array<string>"
PASSAGES = [
    "the quality of mercy is not strained it droppeth as the gentle rain from heaven".split(),
    "now is the winter of our discontent made glorious summer by this sun of york".split(),
    "friends romans countrymen lend me your ears i come to bury caesar not to praise him".split(),
]


def blocks_of(spark, *scenes):
    """Blocks of printed scenes; an entrance or exit is told by its first word."""
    rows = [(1, t, n, words.split() if isinstance(words, str) else words, isinstance(words, str) and words.startswith("enter")) for t, scene in enumerate(scenes) for n, words in enumerate(scene)]
    return spark.createDataFrame(rows, BLOCK)


def test_a_printed_scene_is_split_at_entrances(spark):
    blocks = blocks_of(spark, ["enter a", PASSAGES[0], "exit", "enter b", PASSAGES[1], "enter c", PASSAGES[2]])
    scenes = spark.createDataFrame([(1, t, act, "scene", no, ["enter", x, *PASSAGES[t]]) for t, (act, no, x) in enumerate([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")])], SCENE)
    printed = spark.createDataFrame([(1, 0, 1, "scene", 1)], "doc int, turn int, act int, kind string, no int")
    got = divisions.supplied(printed, blocks, scenes, "doc").orderBy("n").collect()
    # the exit stays with the scene it ends
    assert [(r.act, r.no, r.added) for r in got] == [(1, 1, False)] * 3 + [(1, 2, True)] * 2 + [(2, 1, True)] * 2
    turns = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (1, 2, 2), (1, 3, None), (1, 4, None)], "doc int, turn int, act int")
    heads = spark.createDataFrame([(1, 1, "Actus Primus.", False)], "doc int, act int, heading string, editorial boolean")
    told = divisions.acts(turns, heads, "doc").orderBy("turn").collect()
    assert [(r.heading, r.editorial) for r in told] == [("Actus Primus.", False)] * 2 + [(None, True)] + [(None, False)] * 2
    assert len({r.group for r in told}) == 4


def test_renumbered_scenes_split_the_scene_before(spark):
    blocks = blocks_of(spark, ["enter a", PASSAGES[0], "enter b", PASSAGES[1]], ["enter c", PASSAGES[2]])
    scenes = spark.createDataFrame([(1, t, 1, "scene", t + 1, ["enter", "abc"[t], *PASSAGES[t]]) for t in range(3)], SCENE)
    printed = spark.createDataFrame([(1, 0, 1, "scene", 1), (1, 1, 1, "scene", 2)], "doc int, turn int, act int, kind string, no int")
    mapping = lambda k, t: spark.createDataFrame([(1, k, t)], "doc int, key string, target string")
    got = divisions.supplied(divisions.renumbered(printed, mapping("1.2", "1.3"), "doc"), blocks, scenes, "doc").orderBy("turn", "n").collect()
    assert [(r.no, r.added) for r in got] == [(1, False)] * 2 + [(2, True)] * 2 + [(3, False)] * 2
    with pytest.raises(ValueError, match="no printed scene 1.4"):
        divisions.renumbered(printed, mapping("1.4", "1.3"), "doc")
    for target in ("2.3", "1.x", "1"):
        with pytest.raises(ValueError, match="cannot renumber 1.2"):
            divisions.renumbered(printed, mapping("1.2", target), "doc")


def test_scenes_out_of_order_or_without_counterpart_stop(spark):
    scenes = spark.createDataFrame([(1, t, 1, "scene", t + 1, ["a"]) for t in range(2)] + [(1, 2, 5, "epilogue", None, ["z"])], SCENE)
    place = lambda *rows: spark.createDataFrame([(1, t, *r) for t, r in enumerate(rows)], "doc int, turn int, act int, kind string, no int")
    told = divisions.covered(place((1, "scene", 1), (1, "scene", 2), (None, "epilogue", None)), scenes, "doc").orderBy("turn").collect()
    assert [(r["first"], r.upto) for r in told] == [(0, 1), (1, 2), (2, 3)]
    for rows, says in (([(1, "scene", 2), (1, "scene", 1)], "out of order"), ([(3, "scene", 1)], "no counterpart"), ([(None, "prologue", None)], "no counterpart")):
        with pytest.raises(Exception, match=says):
            divisions.covered(place(*rows), scenes, "doc").collect()


def pieces_by_loop(blocks, scenes):
    starts, words = [], []
    for w, _ in blocks:
        starts.append(len(words))
        words += w
    begins, other = [], []
    for w in scenes:
        begins.append(len(other))
        other += w

    def once(ws):
        seen = {}
        for i in range(len(ws) - 4):
            g = tuple(ws[i : i + 5])
            seen[g] = None if g in seen else i
        return {g: i for g, i in seen.items() if i is not None}

    a, b = once(words), once(other)
    pairs = sorted((b[g], i) for g, i in a.items() if g in b)
    longest = []
    for k, (_, i) in enumerate(pairs):
        longest.append(max(([*longest[j], k] for j in range(k) if pairs[j][1] < i), key=len, default=[k]))
    chain = [pairs[k] for k in max(longest, key=len, default=[])]
    cuts = []
    for m in begins[1:]:
        before = max((p for p in chain if p[0] <= m), default=(0, 0))
        after = min((p for p in chain if p[0] > m), default=None)
        at = before[1] + m - before[0] if after is None else int(before[1] + (m - before[0]) / (after[0] - before[0]) * (after[1] - before[1]) + 0.5)
        options = [(abs(starts[k] - at) + (0 if e else 40), k) for k, (_, e) in enumerate(blocks) if k > (cuts[-1] if cuts else 0)]
        if not options:
            break
        cuts.append(min(options)[1])
    return [sum(c <= k for c in cuts) for k in range(len(blocks))]


def test_pieces_against_plain_loops(spark):
    draw = random.Random(5)
    cases = {}
    for d in range(30):
        vocabulary = [f"w{i}" for i in range(draw.choice((30, 400)))]
        blocks = [([draw.choice(vocabulary) for _ in range(draw.randrange(0, 25))], draw.random() < 0.3) for _ in range(draw.randrange(1, 14))]
        flat = [w for ws, _ in blocks for w in ws if draw.random() < 0.97]
        at = sorted(draw.randrange(len(flat) + 1) for _ in range(draw.randrange(0, 4)))
        cases[d] = (blocks, [flat[x:y] for x, y in zip([0, *at], [*at, len(flat)], strict=True)])
    blocks = spark.createDataFrame([(d, n, w, e) for d, c in cases.items() for n, (w, e) in enumerate(c[0])], "doc int, n int, words array<string>, entrance boolean")
    scenes = spark.createDataFrame([(d, n, w) for d, c in cases.items() for n, w in enumerate(c[1])], "doc int, n int, words array<string>")
    got = {}
    for r in divisions.split(blocks, scenes, ["doc"]).orderBy("doc", "n").collect():
        got.setdefault(r.doc, []).append(r.piece)
    assert got == {d: pieces_by_loop(*c) for d, c in cases.items()}
    assert divisions.split(blocks.limit(0), scenes, ["doc"]).collect() == []
    assert {r.piece for r in divisions.split(blocks, scenes.limit(0), ["doc"]).collect()} == {0}


def smoothed_by_loop(runs, least):
    runs = [list(r) for r in runs]
    while len(runs) > 1 and any(r[2] < least for r in runs):
        k = next(i for i, r in enumerate(runs) if r[2] < least)
        if k:
            runs[k - 1][2] += runs[k][2]
        else:
            runs[1][1:] = [runs[0][1], runs[0][2] + runs[1][2]]
        del runs[k]
        merged = []
        for r in runs:
            if merged and merged[-1][0] == r[0]:
                merged[-1][2] += r[2]
            else:
                merged.append(r)
        runs = merged
    return [tuple(r) for r in runs]


def test_smoothing_against_the_plain_loop():
    draw = random.Random(2)
    for _ in range(3000):
        runs, begin, last = [], 0, None
        for _ in range(draw.randrange(0, 9)):
            label, size = draw.choice([x for x in range(-1, 3) if x != last]), draw.choice((0, 1, 2, 3, 5, 9))
            runs.append((label, begin, size))
            begin, last = begin + 1, label
        assert divisions.smoothed(runs, 4) == smoothed_by_loop(runs, 4)


def labels_by_loop(blocks, scenes):
    grams = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in scenes]
    flat, starts = [], []
    for w in blocks:
        starts.append(len(flat))
        flat += w
    out = []
    for s, w in zip(starts, blocks, strict=True):
        lo, hi = max(0, s - 60), min(len(flat), s + len(w) + 60)
        scores = [0] * len(scenes)
        for i in range(lo, hi - 2):
            held = [k for k, g in enumerate(grams) if tuple(flat[i : i + 3]) in g]
            for k in held:
                scores[k] += round((1 << 40) / len(held))
        out.append(scores.index(max(scores)) if any(scores) else None)
    return out


def test_labels_against_plain_loops(spark):
    draw = random.Random(11)
    cases = {}
    for d in range(12):
        vocabulary = [f"w{i}" for i in range(draw.choice((6, 60)))]
        scenes = [[draw.choice(vocabulary) for _ in range(draw.randrange(0, 120))] for _ in range(draw.randrange(1, 5))]
        blocks = [w for s in draw.sample(scenes, len(scenes)) for w in [s[i : i + 9] for i in range(0, len(s), 9)]] + [["other"] * draw.randrange(0, 90)]
        cases[d] = (blocks, scenes)
    blocks = spark.createDataFrame([(d, n, w, False) for d, c in cases.items() for n, w in enumerate(c[0])], "doc int, n int, words array<string>, entrance boolean")
    scenes = spark.createDataFrame([(d, n, w) for d, c in cases.items() for n, w in enumerate(c[1])], "doc int, n int, words array<string>")
    got = {}
    for r in divisions.labels(blocks, scenes, ["doc"]).orderBy("doc", "n").collect():
        got.setdefault(r.doc, []).append(r.label)
    assert got == {d: labels_by_loop(*c) for d, c in cases.items()}


WORDS = [
    "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu",
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty",
    "mercury venus earth mars jupiter saturn uranus neptune pluto ceres eris makemake haumea sedna quaoar orcus ixion varuna gonggong salacia chaos deucalion huya",
]


def reordered_play(spark):
    long = [(w + " ") * 3 for w in WORDS]
    blocks = blocks_of(spark, [x for k in (0, 2, 1, 0) for x in (f"enter {'abc'[k]}", long[k].split())]).drop("turn")
    return blocks, spark.createDataFrame([(1, t, 1, "scene", t + 1, ["enter", "abc"[t], *long[t].split()]) for t in range(3)], SCENE)


def test_stretches_are_labelled_in_their_own_order(spark):
    blocks, scenes = reordered_play(spark)
    got = divisions.reordered(blocks, scenes.withColumnRenamed("turn", "n"), ["doc"])
    rows = got.orderBy("n").collect()
    assert [(r.run, r.label) for r in rows] == [(0, 0)] * 2 + [(1, 2)] * 2 + [(2, 1)] * 2 + [(3, 0)] * 2
    assert [r.scene for r in divisions.named(got, scenes, "doc").orderBy("run").collect()] == ["1.1", "1.3", "1.2", "1.1b"]


def test_curated_starts_replace_the_automatic_ones(spark):
    blocks, scenes = reordered_play(spark)
    starts = lambda *rows: spark.createDataFrame([(1, t, n, s) for t, (n, s) in enumerate(rows)], "doc int, turn int, n int, scene string")
    got = divisions.curated(blocks, starts((0, "1.1"), (4, "1.2")), scenes, "doc").orderBy("n").collect()
    assert [(r.run, r.label) for r in got] == [(0, 0)] * 4 + [(1, 1)] * 4
    for rows, says in (([(0, "9.9")], "not found"), ([(0, "1.1"), (99, "1.2")], "not found"), ([(1, "1.1")], "first block"), ([(0, "1.1"), (4, "1.2"), (2, "1.3")], "in order")):
        with pytest.raises(ValueError, match=says):
            divisions.curated(blocks, starts(*rows), scenes, "doc")


def test_long_texts_are_divided_in_time_linear_in_them(spark):
    """A text of 12,000 lines: 36,000 landmarks in one window, cuts once a text; both squared it before."""
    rows = spark.range(12_000).selectExpr("1 as doc", "cast(id as int) as n", "array(concat('w', id * 3), concat('w', id * 3 + 1), concat('w', id * 3 + 2)) as words", "id % 50 = 0 as entrance")
    scenes = rows.groupBy("doc", F.expr("cast(floor(n / 3000) as int)").alias("n")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "words"))), lambda r: r["words"])).alias("words"))
    began = time.monotonic()
    got = divisions.split(rows, scenes, ["doc"]).groupBy("piece").agg(F.min("n").alias("first"), F.count("*").alias("size")).orderBy("piece").collect()
    assert [tuple(r) for r in got] == [(k, 3000 * k, 3000) for k in range(4)]
    labelled = divisions.labels(rows, scenes, ["doc"]).groupBy("label").count().orderBy("label").collect()
    assert [tuple(r) for r in labelled] == [(k, 3000) for k in range(4)]
    assert time.monotonic() - began < 60
