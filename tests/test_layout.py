"""Candidates, bodies and stores against small cases."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quirework.operators import bodies, candidates, citations, curation, notes
from quirework.sources import store


def test_forms_of_words(spark):
    cases = {"stopping": ["stopping", "stopp", "stoppe", "stop"], "Cried": ["cried", "cri", "crie", "cry"], "o’er": ["o'er", "over", "oer", "oeer"], "wat'ry": ["watery", "watry"], "king's": ["king"], "blessèd": ["bless", "blessed"], "as": ["as"], "": [""]}
    df = spark.createDataFrame([(w,) for w in cases], "w string")
    got = {r.w: set(r.f) for r in df.select("w", candidates.forms(F.col("w")).alias("f")).collect()}
    assert all(set(want) <= got[w] for w, want in cases.items())
    assert got["as"] == {"as"} and got[""] == {""}


def test_candidates(spark):
    lines = spark.createDataFrame([(1, 0, "The cat’s fardels grunted IX times"), (1, 1, "Hamlet's fardels, and Rome o'erhung"), (1, 2, None)], "by int, idx int, text string")
    words = lambda *ws: spark.createDataFrame([(w,) for w in ws], "word string")
    names = spark.createDataFrame([(1, "Hamlet of Rome")], "by int, name string")
    defined = spark.createDataFrame([(1, 1, 9, 16)], "by int, idx int, start int, end int")
    got = candidates.candidates(lines, "by", words("the", "cat", "time", "grunt"), words("the", "time"), words("cat", "grunt", "rome"), names, defined, ["and", "of"])
    told = [(r.word, r.turn, [tuple(o) for o in r.occurrences]) for r in got.orderBy("turn").collect()]
    # Rome is a headword, so no name alone; cat and grunt are common but headwords, and not among the commonest
    assert told == [("cat's", 1, [(0, 4, 9, "cat’s")]), ("fardels", 2, [(0, 10, 17, "fardels")]), ("grunted", 3, [(0, 18, 25, "grunted")]), ("rome", 4, [(1, 22, 26, "Rome")]), ("o'erhung", 5, [(1, 27, 35, "o'erhung")])]
    assert candidates.candidates(lines.limit(0), "by", words("a"), words("a"), words("a"), names, defined).collect() == []


def test_glossary_tokens(spark):
    lines = spark.createDataFrame([(1, 0, "'Tis well-a-day' — 'the-")], "by int, idx int, text string")
    assert [(r.start, r.end, r.printed) for r in candidates.glossary_tokens(lines, "by").orderBy("n").collect()] == [(1, 4, "Tis"), (5, 15, "well-a-day"), (20, 23, "the")]


def test_rows_of_a_speech(spark):
    nodes = [("line", "prose", None), ("line", "prose", None), ("sd", None, None), ("line", "prose", None), ("line", "verse", "initial"), ("line", "verse", "medial"), ("line", "verse", "final"), ("line", "verse", "final"), ("line", "verse", None), ("line", "verse", "initial"), ("sd", None, None), ("line", "verse", "final")]
    df = spark.createDataFrame([(1, i, *n) for i, n in enumerate(nodes)], "by int, idx int, kind string, form string, part string")
    assert [(r.row, r.row_kind) for r in bodies.rows(df, ["by"]).orderBy("idx").collect()] == [(1, "prose"), (1, "prose"), (2, "sd"), (3, "prose"), (4, "verse"), (4, "verse"), (4, "verse"), (5, "verse"), (6, "verse"), (7, "verse"), (8, "sd"), (9, "verse")]


def test_lines_that_a_range_touches(spark):
    nodes = spark.createDataFrame([(1, i, "sd" if i == 2 else "line") for i in range(5)], "by int, idx int, kind string")
    ranges = spark.createDataFrame([(1, 1, 1, 3), (2, 1, 3, 1), (3, 1, 4, 99), (4, 1, 99, 1)], "id int, by int, start_idx int, end_idx int")
    got = {}
    for r in bodies.touched(nodes, ranges, "by").orderBy("idx").collect():
        got.setdefault(r.id, []).append(r.idx)
    assert got == {1: [1, 3], 2: [1, 3], 3: [4], 4: [0, 1]}


def test_marks_merge_from_a_groups_first(spark):
    marks = spark.createDataFrame([(1, i, t) for i, t in enumerate([0.0, 3.0, 5.0, 8.9, 9.0, 20.0])] + [(2, 9, 1.0)], "by int, id int, top double")
    assert sorted((r.by, r.top, r.ids) for r in bodies.merged_marks(marks, "by", "top").collect()) == [(1, 0.0, [0, 1]), (1, 5.0, [2, 3]), (1, 9.0, [4]), (1, 20.0, [5]), (2, 1.0, [9])]


def test_order_scenes_and_senses(spark):
    nodes = spark.createDataFrame([(1, "b", 0), (1, "a", 1)], "by int, node string, idx int")
    places = spark.createDataFrame([(1, "a", 3), (1, "b", 9), (1, "a", 1), (1, "x", 5)], "by int, node string, start int")
    assert [(r.node, r.start) for r in bodies.in_order(places, nodes, "by").orderBy("turn").collect()] == [("x", 5), ("b", 9), ("a", 1), ("a", 3)]
    text = [(None, "prologue", None, "line", "P.1"), (1, "scene", 1, "line", "1.1.1"), (1, "scene", 1, "sd", None), (1, "scene", 1, "line", None), (2, "prologue", None, "line", "2.P.7")]
    rows = spark.createDataFrame([(1, i, *t) for i, t in enumerate(text)], "by int, idx int, act int, scene_kind string, no int, kind string, n string")
    assert [(r.scene, r.place, r.idx, r.number) for r in bodies.scene_lines(rows, "by").orderBy("idx").collect()] == [("1.1", 1, 1, 1), ("1.1", 2, 3, None), ("prologue", 1, 4, 7)]
    cite = "array<struct<play:string,act:int,scene:int,part:string,line:int,quote:string>>"
    entries = spark.createDataFrame([(1, 1, "Bodkin", "noun", 0, None, "a dagger", [("Hml", 3, 1, None, 76, "q"), ("Tp", 1, 1, None, 2, "")]), (1, 2, "Body", None, 0, None, "", [("Hml", 1, 1, None, 1, "")]), (1, 3, "Boil", None, None, None, None, None)], f"book int, entry int, headword string, part_of_speech string, sense int, label string, gloss string, citations {cite}")
    assert [(r.headword, r.c, r.line) for r in bodies.cited_senses(entries, "Hml").collect()] == [("Bodkin", 0, 76)]


def test_the_earliest_note_is_cited_and_reprints_give_all_ids(spark):
    own = spark.createDataFrame([(1, "l", "2024-02"), (2, "l", "2024-01"), (3, "m", "2024-03")], "id int, line string, made string")
    cites = spark.createDataFrame([("l", 1, "x"), ("k", 1, "y")], "line string, n int, citation string")
    assert {r.line: r.id for r in notes.cited(own, cites, "line", "n", created="made").collect()} == {"l": 2, "k": None}
    works = spark.createDataFrame([("w1", "Same"), ("w2", "same!"), ("w3", "Other")], "work string, title string")
    same = curation.same_works(works, F.regexp_replace(F.lower("title"), "[^a-z]", ""))
    links = spark.createDataFrame([("a", "w1"), ("b", "w2"), ("stale", "w2"), ("a", "w3")], "line string, work string")
    assert sorted(r.work for r in curation.reprint_ids(links, same, 8, 0.25).collect()) == ["w1", "w2"]


def test_citations_by_act(spark):
    """A scene left out is the only one of its act, and a misread one is sought in its act before the whole play."""
    quote = ["when", "himself", "might", "quietus", "make"]
    rows = [("1.1", 1, 10, ["with", "bodkin"]), ("2.1", 1, 10, ["when", "himself", "might", "quietus", "make"]), ("2.1", 2, 11, ["a", "bodkin"]), ("3.1", 1, 80, [*quote]), ("3.1", 2, 81, ["with", "bodkin"]), ("3.2", 1, 5, ["bodkin"])]
    lines = spark.createDataFrame(rows, "scene string, idx int, number int, words array<string>")
    acts = spark.createDataFrame([("1.1", 1), ("2.1", 2), ("3.1", 3), ("3.2", 3)], "scene string, act int")
    asked = [(1, None, 1, 10, "bodkin", []), (2, "3.9", 3, 76, "bodkin", quote), (3, "2.7", 2, 1, "bodkin", quote), (4, "9.9", 9, 1, "bodkin", quote), (5, None, 3, 1, "bodkin", [])]
    cites = spark.createDataFrame(asked, "id int, scene string, act int, line int, head string, quote array<string>")
    got = {r.id: (r.scene, r.idx, r.recovered, r.reason) for r in citations.match(lines, cites, acts=acts).collect()}
    assert got == {1: ("1.1", 1, False, None), 2: ("3.1", 2, True, None), 3: ("2.1", 2, True, None), 4: (None, None, False, "no such scene"), 5: (None, None, False, "no such scene")}
    # without acts the two lines that have the quotation hide each other
    assert citations.match(lines, cites.where("id = 2").drop("act")).first().reason == "no such scene"


def test_a_store(spark, tmp_path):
    folder = str(tmp_path / "store")
    schema = StructType().add("play", "string").add("version", "string").add("text", "string")
    rows = spark.createDataFrame([("p", "a", "x"), ("p", "b", "y"), ("q", "a", "z")], schema)
    assert store.load(spark, folder, "nodes", schema).collect() == []
    with pytest.raises(KeyError, match="no nodes of play p"):
        store.load(spark, folder, "nodes", schema, required=True, play="p")
    store.save(rows, folder, "nodes", ["play", "version"])
    store.save(spark.createDataFrame([("p", "b", "new")], schema), folder, "nodes", ["play", "version"])
    found = store.load(spark, folder, "nodes", schema, required=True, play="p")
    assert sorted((r.version, r.text) for r in found.collect()) == [("a", "x"), ("b", "new")]
    assert "PartitionFilters: [isnotnull(play" in found._jdf.queryExecution().executedPlan().toString()
    notes_ = spark.createDataFrame([("p", "a", "note")], "play string, version string, note string")
    view = store.version_view({"nodes": rows, "notes": notes_}, "nodes", ["play", "version"])
    assert {(r.play, r.version): (len(r.nodes), len(r.notes)) for r in view.collect()} == {("p", "a"): (1, 1), ("p", "b"): (1, 0), ("q", "a"): (1, 0)}
    values = spark.createDataFrame([("size", "14")], "name string, value string")
    one = spark.range(1).select(store.setting(values, "size", F.lit(12)).alias("a"), store.setting(values, "font", F.lit("serif")).alias("b")).first()
    assert tuple(one) == ("14", "serif")
    assert json.loads(store.published(rows))["fields"][2]["name"] == "text"


def test_versions_and_lines(spark, tmp_path):
    steps = [lambda d: d.withColumn("color", F.lit("teal")), lambda d: d.withColumn("size", F.length("text"))]
    rows = spark.createDataFrame([(1, "ab", None, None), (2, "c", 1, "red"), (3, "def", 2, "blue")], "id int, text string, schema_version int, color string")
    got = store.upgraded(rows, steps)
    assert {r.id: (r.color, r.schema_version) for r in got.collect()} == {1: ("teal", 2), 2: ("red", 2), 3: ("blue", 2)}
    assert {r.id: r["size"] for r in got.collect() if r.id < 3} == {1: 2, 2: 1}
    with pytest.raises(ValueError, match="version 2, beyond 1"):
        store.upgraded(rows, steps[:1])
    path = str(tmp_path / "lines")
    table = spark.createDataFrame([(i, f"t{i}") for i in (3, 1, 2)], "id int, text string")
    store.write_lines(table, path, "id")
    lines = [x for p in sorted((tmp_path / "lines").glob("part-*")) for x in p.read_text().splitlines()]
    assert [json.loads(x)["id"] for x in lines] == [1, 2, 3]
    assert sorted(r.id for r in store.read_lines(spark, path, table.schema).collect()) == [1, 2, 3]
