"""Citations, notes and curated results on small cases: nulls, ties, repeats and empty tables."""

import pytest

from quirework.operators import citations, curation, notes

LINE = "scene string, idx int, number int, words array<string>"
CITE = "id int, scene string, line int, head string, quote array<string>"


def lines(spark, *rows):
    return spark.createDataFrame([(s, i, i, None if t is None else t.split()) for s, i, t in rows], LINE)


def cites(spark, *rows):
    return spark.createDataFrame([(n, s, k, h, None if q is None else q.split()) for n, s, k, h, q in rows], CITE)


def places(df):
    return {r.id: (r.scene, r.idx, r.at, r.recovered, r.reason) for r in df.collect()}


def test_citations_are_placed_by_line_quotation_or_not_at_all(spark):
    text = lines(
        spark,
        ("1.1", 1, "the moon shines bright"), ("1.1", 2, None), ("1.1", 3, "gentle sweet moon tonight forever"),
        ("1.1", 30, "moon and moons"), ("2.1", 1, "slow crawls every golden arrow westward"), (None, 1, "moon"),
    )
    asked = cites(
        spark,
        (1, "1.1", 30, "moon", None),  # a lone line near: its last form counts
        (2, "1.1", 2, "moon", ""),  # two lines as near
        (3, "9.9", 4, "arrow", "slow crawls every golden"),  # no such scene, found by its quotation
        (4, "9.9", 4, "arrow", "slow"),
        (5, "1.1", 3, "moon", "gentle sweet tonight moon"),
        (6, "1.1", 3, "moon", "utterly other words"),
        (7, "1.1", 3, "arrow", None),
        (8, "1.1", 3, "m", None), (9, "1.1", 3, None, None),
        (10, None, None, "arrow", "slow crawls every golden"),
    )
    assert places(citations.match(text, asked)) == {
        1: ("1.1", 30, 2, False, None),
        2: (None, None, None, False, "ambiguous"),
        3: ("2.1", 1, 4, True, None),
        4: (None, None, None, False, "no such scene"),
        5: ("1.1", 3, 2, False, None),
        6: (None, None, None, False, "quotation disagrees"),
        7: (None, None, None, False, "headword not found near cited line"),
        8: (None, None, None, False, "unsupported headword"),
        9: (None, None, None, False, "unsupported headword"),
        10: ("2.1", 1, 4, True, None),
    }
    assert citations.match(text.limit(0), asked.limit(0)).count() == 0


def test_prior_pairs_shift_the_predicted_line(spark):
    text = lines(spark, *[("1.1", i, "moon" if i in (10, 50) else "dark night") for i in range(1, 80)])
    asked = cites(spark, (1, "1.1", 30, "moon", None))
    assert places(citations.match(text, asked))[1][4] == "headword not found near cited line"
    prior = spark.createDataFrame([("1.1", 25, 45, 7), ("1.1", 33, 53, 8), ("1.1", 60, 61, 9)], "scene string, cited int, number int, teacher int")
    assert places(citations.match(text, asked, prior))[1] == ("1.1", 50, 0, False, None)


def test_prediction_takes_the_upper_median_of_the_nearest_pairs(spark):
    pairs = [("s", c, c + o, c) for c, o in ((1, 90), (10, 1), (11, 2), (12, 7), (13, 8), (20, 3), (40, 90))]
    df = citations.predicted(cites(spark, (1, "s", 12, "x", None), (2, "t", 12, "x", None)), spark.createDataFrame(pairs, "scene string, cited int, number int, teacher int"))
    assert {r.id: r.predicted for r in df.collect()} == {1: 15, 2: 12}


def test_free_names_take_the_smallest_number(spark):
    wanted = spark.createDataFrame([("v", "Cut"), ("v", "Cut"), ("w", "Cut"), ("v", "Other")], "version string, name string")
    taken = spark.createDataFrame([("v", "Cut"), ("v", "Cut (copy)"), ("v", "Cut (copy 3)")], "version string, name string")
    got = sorted(tuple(r) for r in notes.free_names(wanted, taken, "version", "name", notes.copy_name("name")).collect())
    assert got == [("v", "Cut", "Cut (copy 2)"), ("v", "Cut", "Cut (copy 2)"), ("v", "Other", "Other (copy)"), ("w", "Cut", "Cut (copy)")]
    assert notes.free_names(wanted.limit(0), taken, "version", "name", notes.copy_name("name")).count() == 0


def test_edits_mark_imported_notes_and_repairs_do_not(spark):
    rows = spark.createDataFrame([(1, True, False, "a"), (2, False, False, "b"), (3, False, False, None)], "id int, own boolean, modified boolean, text string")
    edits = spark.createDataFrame([(1, "x"), (2, None), (9, "y")], "id int, text string")
    assert sorted(tuple(r) for r in notes.saved(rows, edits, ["text"]).collect()) == [(1, True, False, "x"), (2, False, True, None), (3, False, False, None)]
    assert [r.modified for r in notes.saved(rows, edits, ["text"], repair=True).orderBy("id").collect()] == [False] * 3
    assert [r.id for r in notes.tombstones(rows, edits).collect()] == [2]


def test_notes_at_a_point_cover_it(spark):
    spans = spark.createDataFrame([(1, 0, 0, 2, 1, 3), (2, 0, 1, 0, 1, 2), (3, 0, 0, 0, 0, 2)], "id int, doc int, start_idx int, start_off int, end_idx int, end_off int")
    nodes = spark.createDataFrame([(0, 0, "abcd"), (0, 1, "efgh")], "doc int, idx int, text string")
    points = spark.createDataFrame([("p", 0, 0, 2), ("q", 0, 1, 1), ("r", 0, 1, 3)], "point string, doc int, idx int, off int")
    assert sorted(tuple(r) for r in notes.at_points(spans, points, nodes, "doc").collect()) == [("p", 1), ("q", 1), ("q", 2)]


def test_a_curated_entry_that_touches_nothing_raises(spark):
    entry = "d int, entry int, orig array<int>, modern array<int>, relation string"
    entries = spark.createDataFrame([(1, 0, [1], [1], "same")], entry)
    curated = spark.createDataFrame([(1, 1, [7], [], "orig-only")], entry.replace("entry", "k"))
    with pytest.raises(Exception, match="touched by curated entry 1"):
        curation.curated_alignment(entries, curated, "d").collect()
    assert curation.curated_alignment(entries, curated.limit(0), "d").count() == 1


def test_same_titles_count_as_the_first_work(spark):
    works = spark.createDataFrame([(1, "A b", 1990, "h"), (2, "ab", 2020, "h"), (3, "", None, "h"), (4, None, 2001, "h"), (5, "c", 1980, "x")], "work int, title string, year int, field string")
    links = spark.createDataFrame([(1, 2), (1, 1), (1, 3), (1, 4), (1, 5), (2, 2), (9, 3)], "line int, work int")
    from pyspark.sql import functions as F

    key = F.regexp_replace(F.coalesce("title", F.lit("")), "[^A-Za-z]", "").alias("k")
    shown = curation.quotation_links(works, links, spark.createDataFrame([(1,), (2,)], "line int"), works.where("work = 9").select("work"), F.lower(key), "h", 100)
    assert sorted(tuple(r) for r in shown.collect()) == [(1, 1, 4), (1, 2, 1), (1, 3, 3), (2, 1, 1)]
