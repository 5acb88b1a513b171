"""Editions, archives and bibliographies against small files."""

import io
import zipfile

import pytest

from quirework.sources import files, markup

PLAY = """<?xml version="1.0"?><t:TEI xmlns:t="urn:x"><head>Title</head><div1 n="1"><div2 n="1"><stage>Enter
<name>Theseus</name>.</stage><sp who="THE"><speaker>Theseus</speaker><l n="1">Now, <hi>fair</hi> Hippolyta,<note>our &amp; notes</note></l>
<l n="2">our <l n="x">nuptial</l> hour</l></sp><sp><l/></sp></div2><div2><sp who="HIP"><l>Four days<!-- gone --></l></sp></div2></div1><l>after</l></t:TEI>"""


def test_nodes_of_an_edition_keep_order_text_and_place(spark):
    made = [("a", PLAY.encode()), ("b", b""), ("c", None), ("d", b"<x/>")]
    stream = markup.events(spark.createDataFrame(made, "path string, content binary"), piece=7, batch=3)
    found = markup.nodes(stream, {"l": "line", "stage": "direction"}, {"act": ("div1", "n"), "scene": ("div2", "n"), "who": ("sp", "who")}, ["note"])
    got = [(r.path, r.idx, r.kind, r.attributes.get("n"), r.text, r.act, r.scene, r.who, r.speech) for r in markup.speeches(found, "who").orderBy("path", "idx").collect()]
    assert got == [
        ("a", 0, "direction", None, "Enter Theseus.", "1", "1", None, 0),
        ("a", 1, "line", "1", "Now, fair Hippolyta,", "1", "1", "THE", 1),
        ("a", 2, "line", "2", "our nuptial hour", "1", "1", "THE", 1),
        ("a", 3, "line", None, "", "1", "1", None, 2),
        ("a", 4, "line", None, "Four days", "1", None, "HIP", 3),
        ("a", 5, "line", None, "after", None, None, None, 4),
    ]
    with pytest.raises(Exception, match="mismatched tag"):
        markup.events(spark.createDataFrame([("e", b"<a><b></a>")], "path string, content binary")).collect()


def test_zip_members_and_sized_word_lists(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("w/english-words.10", "Tea\nisn’t\n".encode())
        z.writestr("w/english-words.70", "rare\n")
        z.writestr("w/names.10", "Bob\n")
        z.writestr("w/README", "no list\n")
    archive = spark.createDataFrame([("z", data.getvalue())], "path string, content binary")
    assert {r.member for r in files.zip_members(archive).collect()} == {"w/english-words.10", "w/english-words.70", "w/names.10", "w/README"}
    assert [bytes(r.content) for r in files.zip_members(archive, "w/names.10").collect()] == [b"Bob\n"]
    assert {r.word for r in files.word_list(files.zip_members(archive), "UTF-8", ["english-words"], 50).collect()} == {"tea", "isn't"}


def test_bibliographies_are_told_apart(spark):
    bib = '@article{k1,\n  title = {On {G}hosts, {and {n}ames}},\n author={Roe, Jane and  {The Club}}, year = 1999, doi="10.1/x" }\n@book{k2, editor = "Doe, A.", date={2001-03}}\n@misc{k3, Title="Plain"}'
    csl = '[{"title": "Other", "author": [{"family": "Roe", "given": "J."}, {"literal": "Club"}], "issued": {"date-parts": [[2004, 5]]}, "DOI": "d"}, {"author": []}]'
    ris = "TY  - JOUR\nTI  - Third\nER  -\n"
    rows = [("b", bib), ("c", csl), ("r", ris), ("o", '{"title": "One"}'), ("n", None), ("e", ""), ("x", "[not json"), ("p", "plain")]
    got = files.bibliography(spark.createDataFrame(rows, "path string, text string")).orderBy("path", "n").collect()
    assert [(r.path, r.n, r.title, r.authors, r.year, r.doi) for r in got] == [
        ("b", 0, "On Ghosts, and names", ["Roe, Jane", "The Club"], 1999, "10.1/x"),
        ("b", 1, "Plain", [], None, None),
        ("c", 0, "Other", ["Roe, J.", "Club"], 2004, "d"),
        ("o", 0, "One", [], None, None),
        ("r", 0, "Third", [], None, None),
    ]
