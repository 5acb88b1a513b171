"""Whole versions aligned, and their numbers and speakers, against small cases and plain loops."""

import random
import time

import pytest

from quirework.operators import aligned, sequences

SCENE = "play int, turn int, act int, kind string, no int"
NODE = "play int, turn int, idx int, kind string, keys array<string>"


def scene_by_loop(orig, modern):
    """Entries of one scene pair, with a table of lengths and groups by hand; nodes are (n, kind, keys)."""
    tokens = lambda nodes: [(n, f"{k}:{w}") for n, k, ws in nodes for w in ws]
    a, b = tokens(orig), tokens(modern)
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][1] == b[j][1] else max(best[i + 1][j], best[i][j + 1])
    groups, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i][1] == b[j][1]:
            near = [g for g in groups if a[i][0] in g[0] or b[j][0] in g[1]]
            one = (sorted({a[i][0]}.union(*[g[0] for g in near])), sorted({b[j][0]}.union(*[g[1] for g in near])))
            groups = [g for g in groups if g not in near] + [one]
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    said = lambda nodes, ns: [w for n, _, ws in nodes if n in ns for w in ws]
    known = [(o, m, "same" if sequences.equivalent(said(orig, o), said(modern, m)) else "variant") for o, m in groups]
    known += [([n], [], "orig-only") for n, *_ in orig if not any(n in g[0] for g in groups)]
    rest = [([], [n], "modern-only") for n, *_ in modern if not any(n in g[1] for g in groups)]
    out = []
    for entry in sorted(known):
        while rest and entry[1] and rest[0][1][0] < entry[1][0]:
            out.append(rest.pop(0))
        out.append(entry)
    return out + rest


def versions_by_loop(orig, modern, os_, ms):
    """Entries of whole versions; scenes are (key, nodes)."""
    index = {k: i for i, (k, _) in enumerate(ms)}
    where = [index[k.rstrip("b")] for k, _ in os_]
    by_piece = [[] for _ in os_]
    for m in sorted(set(where)):
        pieces = [i for i, w in enumerate(where) if w == m]
        of = {n[0]: i for i in pieces for n in os_[i][1]}
        now = pieces[0]
        for entry in scene_by_loop([n for i in pieces for n in os_[i][1]], ms[m][1]):
            now = of[entry[0][0]] if entry[0] else now
            by_piece[now].append(entry)
    out, upto = [], 0
    lone = lambda a, b: [([], [n[0]], "modern-only") for k in range(a, b) if k not in where for n in ms[k][1]]
    for i, w in enumerate(where):
        if w >= upto:
            out += lone(upto, w)
            upto = w
        out += by_piece[i]
    return out + lone(upto, len(ms))


def tables(spark, plays):
    scene = lambda side: spark.createDataFrame([(p, t, *((None, k, None) if k.isalpha() else (1, "scene", int(k.rstrip("b"))))) for p, v in plays.items() for t, (k, _) in enumerate(v[side])], SCENE)
    nodes = lambda side: spark.createDataFrame([(p, t, n, kind, ws) for p, v in plays.items() for t, (_, ns) in enumerate(v[side]) for n, kind, ws in ns], NODE)
    return nodes(0), nodes(1), scene(0), scene(1)


def numbered(*scenes):
    at, out = 0, []
    for key, lines in scenes:
        out.append((key, [(at + i, kind, ws) for i, (kind, ws) in enumerate(lines)]))
        at += len(lines)
    return out


def test_versions_against_plain_loops(spark):
    draw = random.Random(4)
    plays = {}
    for p in range(25):
        words = [f"{draw.choice('abcdefg')}{draw.choice('xyz')}{i}" for i in range(draw.choice((4, 12)))]
        line = lambda: (draw.choice(("line", "line", "sd")), [draw.choice(words) for _ in range(draw.randrange(0, 6))])  # noqa: E731, B023
        modern = [("prologue", [line()])] * draw.randrange(2) + [(str(k), [line() for _ in range(draw.randrange(1, 6))]) for k in range(1, draw.randrange(2, 5))]
        orig = [(k, [x if draw.random() < 0.7 else line() for x in ls if draw.random() < 0.8]) for k, ls in modern if draw.random() < 0.8]
        orig = [x for k, ls in orig for x in ([(k, ls[:1]), (k + "b", ls[1:])] if k.isdigit() and draw.random() < 0.4 else [(k, ls)])]
        draw.shuffle(orig)
        plays[p] = (numbered(*orig), numbered(*modern))
    got = {}
    for r in aligned.versions(*tables(spark, plays), "play").orderBy("play", "entry").collect():
        got.setdefault(r.play, []).append((r.orig, r.modern, r.relation))
    assert got == {p: w for p, (o, m) in plays.items() if (w := versions_by_loop(None, None, o, m))}


def test_pieces_of_one_scene_align_together(spark):
    line = lambda t: ("line", t.split())
    modern = numbered(("prologue", [line("in troi")]), ("1", [line("first of"), line("second of")]), ("2", [line("onli")]))
    orig = numbered(("1", [line("first of")]), ("2", [line("onli")]), ("1b", [line("second of")]))
    got = aligned.versions(*tables(spark, {1: (orig, modern)}), "play").orderBy("entry").collect()
    assert [(r.orig, r.modern, r.relation) for r in got] == [([], [0], "modern-only"), ([0], [1], "same"), ([1], [3], "same"), ([2], [2], "same")]


def test_a_scene_without_counterpart_stops(spark):
    line = lambda t: ("line", t.split())
    with pytest.raises(Exception, match="scene 1.2 has no counterpart"):
        aligned.versions(*tables(spark, {1: (numbered(("1", [line("x")]), ("2", [])), numbered(("1", [line("x")])))}), "play").collect()


def test_numbers_and_first_use(spark):
    orig = spark.createDataFrame([(1, i, "sd" if i == 2 else "line") for i in range(6)], "play int, idx int, kind string")
    modern = spark.createDataFrame([(1, i, "line", n) for i, n in enumerate(["1.1.1", "1.1.2", None, "1.1.3", "1.1.3", "1.1.4"])], "play int, idx int, kind string, number string")
    entries = spark.createDataFrame([(1, 0, [0, 1, 2], [0, 1]), (1, 1, [3], [3, 5]), (1, 2, [4], [4]), (1, 3, [5], [2]), (1, 4, [], [5])], "play int, entry int, orig array<int>, modern array<int>")
    assert sorted((r.idx, r.number) for r in aligned.numbers(orig, modern, entries, "play").collect()) == [(0, "1.1.1"), (1, "1.1.2"), (3, "1.1.3")]


def test_speakers_follow_printed_labels(spark):
    speeches = spark.createDataFrame([(1, s, label, i) for s, (label, nodes) in enumerate([("Ham.", [0, 1]), ("HAM", [2]), ("Hor.", [3]), ("", [4]), (None, [5]), ("Ghost.", [6])]) for i in nodes], "play int, speech int, label string, idx int")
    voices = spark.createDataFrame([(1, i, who) for i, who in enumerate([["hamlet"], ["hamlet"], ["horatio"], ["horatio", "all"], ["ghost"], [], ["ghost"]])], "play int, idx int, speakers array<string>")
    entries = spark.createDataFrame([(1, i, [i], [i]) for i in range(7)], "play int, entry int, orig array<int>, modern array<int>")
    set_ = spark.createDataFrame([(1, "Ghost.", ["spirit"])], "play int, label string, speakers array<string>")
    told = aligned.speakers(speeches, voices, entries, "play", set_)
    assert {r.speech: r.speakers for r in told.collect()} == {0: ["hamlet"], 1: ["hamlet"], 2: ["horatio", "all"], 3: ["ghost"], 4: [], 5: ["spirit"]}
    people = spark.createDataFrame([(1, x) for x in ("hamlet", "ghost", "osric")], "play int, id string")
    assert sorted(r.id for r in aligned.cast(people, told, "play").collect()) == ["ghost", "hamlet"]


def test_common_of_long_texts_is_quick():
    """A row is a number of bits: 40,000 words against 32,000 took nine seconds when a row was an array of lengths."""
    b = [str(k * k % 7919) for k in range(40_000)]
    a = [w for k, w in enumerate(b) if k % 50 > 9]
    began = time.process_time()
    pairs = sequences.common(a, b)
    assert time.process_time() - began < 5
    assert len(pairs) == len(a) and all(a[i] == b[j] for i, j in pairs) and all(p < q for p, q in zip(pairs, pairs[1:], strict=False))


def test_common_makes_masks_again_where_they_do_not_fit(monkeypatch):
    a, b = list("abcabbacab"), list("bacbabcabca")
    whole = sequences.common(a, b)
    monkeypatch.setattr(sequences, "_HELD", 0)
    assert sequences.common(a, b) == sequences.common(a, b, 2) == whole
