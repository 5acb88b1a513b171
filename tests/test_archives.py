"""Archives of notes: a round trip, every refusal, and every rejected record."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quirework.sources import archives

ANCHOR = {"start": {"nodeId": "l1", "offset": 0}, "end": {"nodeId": "l1", "offset": 4}, "quote": {"exact": "word", "prefix": "", "suffix": " é\n“"}, "revision": "r"}
BASE = {"versionId": "v", "anchor": ANCHOR, "createdAt": "2024", "updatedAt": "2024"}
DEFINITION = {"id": "d1", **BASE, "meaning": "a \"thing\"", "partOfSpeech": "noun"}
ANNOTATION = {"id": "a1", **BASE, "color": "teal", "notes": "n", "links": [{"url": "https://x"}], "citations": [{"type": "book", "title": "T", "volume": "1"}]}
CUT = {"id": "c1", "versionId": "v", "name": "Short", "createdAt": "2024", "updatedAt": "2024", "operations": [{"id": "o1", "type": "hide", "anchor": ANCHOR}, {"id": "o2", "type": "replace", "anchor": ANCHOR, "text": "t"}, {"id": "o3", "type": "insert", "after": "l1", "kind": "sd", "text": "Exit."}]}
NOTES = {"format": "notes", "formatVersion": 1, "exportedAt": "2024", "generator": {"app": "x", "version": "1"}, "collection": {"name": " Mine "}, "play": {"id": "p"}, "versions": {"v": {"revision": "r"}}, "definitions": [DEFINITION], "annotations": [ANNOTATION]}
CUTS = {"format": "cuts", "formatVersion": 1, "play": {"id": "p"}, "cuts": [CUT]}


def zipped(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(f"{name}.json", data if isinstance(data, (str, bytes)) else json.dumps(data))
    return out.getvalue()


def table(spark, files):
    return spark.createDataFrame([(p, c) for p, c in files.items()], "path string, content binary")


def test_refusals_of_whole_files(spark):
    damaged = bytearray(zipped(notes=NOTES))
    damaged[60:90] = bytes(30)
    files = {
        None: None,
        "too large": (b"PK\x03\x04" + bytes(200_000), "archive too large"),
        "text": (b"hello", "not a ZIP file"), "empty": (b"", "not a ZIP file"), "null": (None, "not a ZIP file"),
        "damaged": (bytes(damaged), "damaged ZIP file"), "cut off": (zipped(notes=NOTES)[:80], "damaged ZIP file"),
        "bomb": (zipped(notes=b" " * 300_000), "notes too large"), "two bombs": (zipped(notes=b" " * 150_000, cuts=b" " * 150_000), "notes too large"),
        "other": (zipped(readme="x"), "no notes in it"),
        "no json": (zipped(notes="{"), "notes.json: not valid JSON"), "list": (zipped(notes="[]"), "not a notes file"),
        "format": (zipped(notes=NOTES | {"format": "other"}), "not a notes file"), "newer": (zipped(notes=NOTES | {"formatVersion": 2, "definitions": 1}), "made by a newer version"),
        "older": (zipped(notes=NOTES | {"formatVersion": 0}), "notes.json: incomplete at formatVersion"), "no version": (zipped(notes={"format": "notes"}), "notes.json: incomplete at formatVersion"),
        "no name": (zipped(notes=NOTES | {"collection": {"name": "  "}}), "notes.json: incomplete at collection.name"), "no play": (zipped(notes=NOTES | {"play": {"id": ""}}), "notes.json: incomplete at play.id"),
        "no revision": (zipped(notes=NOTES | {"versions": {"v": {}}}), "notes.json: incomplete at versions"), "no list": (zipped(notes=NOTES | {"annotations": {}}), "notes.json: incomplete at annotations"),
        "cuts": (zipped(notes=NOTES, cuts="x"), "cuts.json: not valid JSON"), "newer cuts": (zipped(notes=NOTES, cuts=CUTS | {"formatVersion": 9}), "made by a newer version"),
        "other play": (zipped(notes=NOTES, cuts=CUTS | {"play": {"id": "q"}}), "cuts of another play"),
        "good": (zipped(notes=NOTES, cuts=CUTS, more="x"), None),
    }
    files.pop(None)
    layout = archives.Layout(archive_bytes=100_000, json_bytes=200_000)
    summary, records = archives.read(table(spark, {p: c for p, (c, _) in files.items()}), layout)
    assert {r.path: r.refused for r in summary.collect()} == {p: why for p, (_, why) in files.items()}
    assert [(r.path, r.play, r.collection, r.accepted, r.rejected) for r in summary.where("whole").collect()] == [("good", "p", "Mine", 3, 0)]
    assert sorted((r.path, r.kind, json.loads(r.record)) for r in records.collect() if r.kind != "cuts") == sorted([("good", "definitions", DEFINITION), ("good", "annotations", ANNOTATION)], key=lambda x: x[1])


def test_records_are_held_against_the_format_one_by_one(spark):
    without = lambda record, *path: json.loads(json.dumps(record), object_hook=lambda o: {k: v for k, v in o.items() if k not in path})
    bad = {
        "definitions": [(DEFINITION, None), (DEFINITION | {"id": ""}, "id"), (DEFINITION | {"versionId": 3}, "versionId"), (without(DEFINITION, "start"), "anchor.start"), (DEFINITION | {"anchor": ANCHOR | {"end": {"nodeId": "x", "offset": -1}}}, "anchor.end"), (DEFINITION | {"anchor": ANCHOR | {"end": {"nodeId": "x", "offset": 1.5}}}, "anchor.end"), (without(DEFINITION, "exact"), "anchor.quote"), (without(DEFINITION, "revision"), "anchor.revision"), (without(DEFINITION, "createdAt"), "createdAt"), (DEFINITION | {"meaning": None}, "meaning"), (DEFINITION | {"partOfSpeech": "thing"}, "partOfSpeech"), (DEFINITION | {"source": 1}, "source"), (DEFINITION | {"meaning": "m" * 21}, "too long"), (without(DEFINITION, "partOfSpeech"), None), ("text", "id")],
        "annotations": [(ANNOTATION, None), (without(ANNOTATION, "color"), "color"), (ANNOTATION | {"notes": 7}, "notes"), (ANNOTATION | {"links": [{"url": "x"}, {}]}, "links"), (ANNOTATION | {"links": {}}, "links"), (ANNOTATION | {"citations": [{"type": "book"}]}, "citations"), (ANNOTATION | {"notes": "n" * 31}, "too long"), (ANNOTATION | {"links": []}, None)],
        "cuts": [(CUT, None), (CUT | {"name": " "}, "name"), (CUT | {"operations": [{"id": "o", "type": "move"}]}, "operations"), (CUT | {"operations": [{"id": "o", "type": "insert", "after": "", "kind": "sd", "text": ""}]}, "operations"), (CUT | {"operations": [{"id": "o", "type": "replace", "anchor": ANCHOR}]}, "operations"), (CUT | {"operations": [{"id": "o", "type": "replace", "anchor": ANCHOR, "text": "x" * 9}]}, "too long")],
    }
    file = zipped(notes=NOTES | {k: [r for r, _ in bad[k]] for k in ("definitions", "annotations")}, cuts=CUTS | {"cuts": [r for r, _ in bad["cuts"]]})
    summary, records = archives.read(table(spark, {"f": file}), archives.Layout(meaning=20, text=30, cut_text=8))
    got = {}
    for r in records.orderBy("kind", "n").collect():
        got.setdefault(r.kind, []).append(r.reason)
    assert got == {k: [why for _, why in v] for k, v in bad.items()}
    one = summary.first()
    reasons = [why for v in bad.values() for _, why in v]
    assert (one.refused, one.accepted, one.rejected, one.whole) == (None, reasons.count(None), len(reasons) - reasons.count(None), False)


def test_round_trip(spark):
    collections = spark.createDataFrame([("a", "p", 'My "notes"\n', "2024", {"v": "r"}), ("b", "p", "No cuts", None, {})], "path string, play string, collection string, exported_at string, versions map<string,string>")
    rows = [("a", "definitions", 1, DEFINITION | {"id": "d2"}), ("a", "definitions", 0, DEFINITION), ("a", "annotations", 0, ANNOTATION), ("a", "cuts", 0, CUT), ("b", "definitions", 0, DEFINITION)]
    records = spark.createDataFrame([(p, k, n, json.dumps(r)) for p, k, n, r in rows], "path string, kind string, n int, record string")
    files = archives.written(collections, records)
    assert [bytes(r.content) for r in files.orderBy("path").collect()] == [bytes(r.content) for r in archives.written(collections, records.orderBy("record")).orderBy("path").collect()]
    summary, read = archives.read(files)
    assert sorted(tuple(r) for r in summary.collect()) == [("a", None, "p", 'My "notes"', 4, 0, True), ("b", None, "p", "No cuts", 1, 0, True)]
    order = lambda x: (x[0], x[1], x[2])
    assert sorted([(r.path, r.kind, r.n, json.loads(r.record)) for r in read.collect()], key=order) == sorted(rows, key=order)
    names = {r.path: sorted(zipfile.ZipFile(io.BytesIO(bytes(r.content))).namelist()) for r in files.collect()}
    assert names == {"a": ["cuts.json", "notes.json"], "b": ["notes.json"]}


@pytest.mark.parametrize("part", ["files", "collections"])
def test_nothing_to_read_or_write(spark, part):
    if part == "files":
        assert [t.collect() for t in archives.read(table(spark, {"x": b""}).limit(0))] == [[], []]
    else:
        none = spark.createDataFrame([], "path string, play string, collection string, exported_at string, versions map<string,string>")
        assert archives.written(none, spark.createDataFrame([], "path string, kind string, n int, record string")).select(F.count("*")).first()[0] == 0
