"""Variants seeded from marked passages, and where they show in each version."""

import pytest
from pyspark.sql import functions as F

from quirework.operators import variants

NODE = "play int, version string, idx int, text string, number string"
TOKEN = "play int, passage string, description string, turn int, idx int, start int, end int"
ENTRY = "play int, version string, entry int, orig array<int>, modern array<int>"


@pytest.mark.parametrize(
    ("description", "want"),
    [("text from the Folio not found in the Second Quarto", ["q2-1604"]), ("lines from the Second Quarto not found in the Folio", ["f1-1623"]), ("editorial emendation", []), ("not found in the first quarto", ["q1-1603"]), ("not found in the Quarto", ["q1-1603", "q2-1604"]), (None, [])],
)
def test_versions_that_lack_a_passage(spark, description, want):
    df = spark.createDataFrame([(description, v) for v in ("q1-1603", "q2-1604", "f1-1623")], "d string, v string")
    assert [r.v for r in df.where(variants.lacks(F.col("d"), F.col("v"))).collect()] == want


def seeded(spark, tokens, modern, originals, entries):
    nodes = spark.createDataFrame(modern, NODE)
    found = variants.passages(spark.createDataFrame(tokens, TOKEN), nodes, "play")
    read = variants.seeded(found, spark.createDataFrame(originals, NODE), spark.createDataFrame(entries, ENTRY), "play")
    titles = {r.passage: r.title for r in found.select("passage", variants.title(F.col("description"), F.col("text"), F.col("number")).alias("title")).collect()}
    return titles, {(r.passage, r.version): (r.start_idx, r.start_off, r.end_idx, r.end_off, r.text) for r in read.collect()}


def test_readings_through_alignment(spark):
    modern = [(1, "ed", 0, "And why such daily cast of brazen cannon", "1.1.84"), (1, "ed", 1, "I think it be no other but e’en so.", "1.1.120"), (1, "ed", 2, "   ", None)]
    folio = [(1, "f1-1623", 0, "And why such dayly Cast of Brazon Cannon", None), (1, "f1-1623", 1, "I thinke it be", None)]
    tokens = [
        (1, "a", "text from the Folio not found in the Second Quarto", 0, 0, 19, 23),
        (1, "b", "lines from the Second Quarto not found in the Folio", 0, 1, 0, 7), (1, "b", "lines from the Second Quarto not found in the Folio", 1, 1, 8, 35),
        (1, "c", "editorial emendation", 0, None, None, None),
        (1, "d", "editorial emendation", 0, 2, 0, 2),
        (1, "e", "editorial emendation", 0, None, None, None), (1, "e", "editorial emendation", 1, 0, 0, 3), (1, "e", "editorial emendation", 2, 1, 0, 1),
    ]
    titles, read = seeded(spark, tokens, modern, folio, [(1, "f1-1623", 0, [0], [0]), (1, "f1-1623", 1, [1], [1])])
    # c is not in the text, d has none; the edition outranks the alignment of b
    assert titles == {"a": "Text from the Folio not found in the Second Quarto: “cast” (1.1.84)", "b": "Lines from the Second Quarto not found in the Folio: “I think it be no other but e’en so.” (1.1.120)", "e": "Editorial emendation: “And why such daily cast of brazen cannon I” (1.1.84)"}
    assert read == {("a", "f1-1623"): (0, 0, 0, 40, folio[0][3]), ("b", "f1-1623"): (None, None, None, None, ""), ("e", "f1-1623"): (0, 0, 1, 14, "And why such dayly Cast of Brazon Cannon\nI thinke it be")}


def test_the_first_run_of_a_scattered_version_counts(spark):
    modern = [(1, "ed", i, f"line {i}", None) for i in range(4)]
    quarto = [(1, "q1-1600", i, f"L{i}", None) for i in range(12)]
    tokens = [(1, "p", "x", 0, 0, 0, 4), (1, "p", "x", 1, 3, 0, 4)]
    entries = [(1, "q1-1600", 0, [2], [0]), (1, "q1-1600", 1, [5], [1, 2]), (1, "q1-1600", 2, [9, 10], [3])]
    assert seeded(spark, tokens, modern, quarto, entries)[1] == {("p", "q1-1600"): (2, 0, 5, 2, "L2\nL3\nL4\nL5")}


def test_marks_in_a_version(spark):
    nodes = spark.createDataFrame([(1, v, i, f"some words {i}", None) for v in ("ed", "q1", "f1") for i in range(4)], NODE)
    reading = "play int, variant string, turn int, version string, rank int, start_idx int, start_off int, end_idx int, end_off int, text string"
    gone = (None, None, None, None, "")
    rows = [
        (1, "a", 0, "ed", 0, 1, 0, 1, 4, "some"), (1, "a", 0, "q1", 1, 0, 5, 1, 4, "x"), (1, "a", 0, "f1", 2, *gone),
        (1, "b", 1, "ed", 0, 2, 0, 2, 4, "some"), (1, "b", 1, "q1", 1, 2, 0, 2, 3, "y\nz"), (1, "b", 1, "f1", 2, *gone),
        (1, "c", 2, "ed", 0, 3, 0, 3, 4, "some"), (1, "c", 2, "q1", 1, 3, 0, 3, 3, "w\nv"), (1, "c", 2, "f1", 2, *gone),
        (1, "d", 3, "ed", 0, 0, 0, 0, 4, "some"), (1, "d", 3, "q1", 1, *gone), (1, "d", 3, "f1", 2, *gone),
        (1, "e", 4, "f1", 0, 99, 0, 99, 1, "lost"),
    ]
    versions = spark.createDataFrame([(1, "ed", False, "Edition"), (1, "q1", True, "Quarto"), (1, "f1", True, "Folio")], "play int, version string, original boolean, name string")
    entries = spark.createDataFrame([(1, "f1", 0, [0], [0]), (1, "f1", 1, [1], [1]), (1, "f1", 2, [], [2, 3])], ENTRY)
    spans, begun, absent = variants.marks(spark.createDataFrame(rows, reading), versions, nodes, entries, "play", "ed")
    assert sorted(tuple(r)[1:] for r in spans.where("version = 'q1'").collect()) == [("q1", 0, 5, 12, "a"), ("q1", 1, 0, 4, "a"), ("q1", 2, 0, 3, "b"), ("q1", 3, 0, 3, "c")]
    assert {(r.version, r.idx): r.variants for r in begun.collect() if r.version != "ed"} == {("q1", 0): ["a"], ("q1", 2): ["b"], ("q1", 3): ["c"], ("f1", 1): ["a"]}
    # d is in no other original; b and c say the same behind the same node
    assert [tuple(r)[1:] for r in absent.collect()] == [("f1", 1, "Quarto has 2 lines here", ["b", "c"])]
    none = variants.marks(spark.createDataFrame(rows, reading).limit(0), versions, nodes, entries, "play", "ed")
    assert [t.collect() for t in none] == [[], [], []]
