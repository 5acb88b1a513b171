"""Dictionary scans: numerals, noise, entries, senses and citations of printed samples, and awkward books."""

import pytest
from pyspark.sql import functions as F

from quirework.sources import dictionaries as dic

FIRST = [
    "Bodkin, a sharp instrument to make holes ",
    "by piercing: what is this? a cittern-head; the head of ",
    "a b. LLL V, 2, 615. when he himself might his quietus ",
    "make with a bare b. Hml. III, 1, 76. ",
    "",
    "Body, subst., 1) the frame of an animal: though ",
    "nothing but my —’s bane would cure thee, Ven. 372. Tp. IV, 191. ",
    "",
    "Boast 115 Bob",
    "2) corpse: Hml. IV, 2, 28. ",
    "| ~ . 7 ;",
    "",
    "Bodykins, see Bodkin. ",
    "",
    "Boil, vb., trans. a) to dress or cook in boiling wa- ",
    "",
    "ter; absol.: Tp. II, 1, 76. Hence = to seethe: the sea b-s, Tp. 12. ",
    "Wint, III, 3, 64.",
]
SECOND = [
    "abase :  to  lower  (the  eyes)  2H6  i.  ii.  15,  R3  i.  ii.", "", "248  (Ff).", "",
    "abate  (1  the  usual  sense ;  the  corresponding  intr.", "", "sense  ' decrease '  is  rare)", "",
    "1  to  lessen,  shorten  MND.  in.  ii.  432  A.  thy  hours!", "",
    "2  to  blunt,  fig.  2H4  I.  i.  117  his  metal  once  in  him", "", "abated,  R3  v.  iv.  48  [v.  35]  Abate  the  edge  of  traitors.", "",
    "ABATE — ABHOR    3", "",
    "bodkin  (1  the  orig.  sense)", "", "1  dagger  Ham.  in.  i.  76  When  he  himself  might  his", "", "quietus  make  With  a  bare  bodkin.", "",
    "bosky  :  shrubby  Tp.  iv.  i.  81  My  bosky  acres.  %  Survives  in  dial.", "",
    "coil  (kept  a  coil)", "", "1  noise,  disturbance  Err.  in.  i.  48.", "",
    "2  fuss,  to-do  Ado  in.  iii.  99 ;  mortal  coil,  bustle  or  turmoil  of  this", "", "mortal  life  Ham.  m.  i.  67  this  mortal  coil ;  cf.  Tp.  i.  ii.  207.",
]


def book(spark, *books):
    return spark.createDataFrame([(b, n, line) for b, lines in enumerate(books) for n, line in enumerate(lines)], "book int, n int, line string")


def told(rows):
    return [(r.headword, r.part_of_speech, r.label, r.gloss, [tuple(c) for c in r.citations or ()]) for r in rows.orderBy("book", "entry", "sense").collect()]


def test_misread_numerals(spark):
    one = {"I": 1, "Il": 2, "IU": 3, "Ill": 3, "HI": 3, "TII": 3, "lV": 4, "Y": 5, "IIII": 3, "XL": None}
    two = {"i": 1, "n": 2, "in": 3, "m": 3, "hi": 3, "ill": 3, "rv": 4, "iv": 4, "v": 5, "vii": 7, "xiii": 13, "xv": 15, "xvi": None, "the": None}
    for values, of in ((one, dic.roman_first), (two, dic.roman_second)):
        df = spark.createDataFrame(list(values.items()), "t string, n int")
        assert {r.t: r.n for r in df.select("t", of(F.col("t")).alias("n")).collect()} == values


def test_entries_and_senses_of_the_first(spark):
    assert told(dic.first_dictionary(book(spark, FIRST))) == [
        ("Bodkin", None, None, "a sharp instrument to make holes by piercing", [("LLL", 5, 2, None, 615, "what is this? a cittern-head; the head of a b"), ("Hml", 3, 1, None, 76, "when he himself might his quietus make with a bare b")]),
        ("Body", "noun", "1", "the frame of an animal", [("Ven", None, None, None, 372, "though nothing but my —’s bane would cure thee"), ("Tp", 4, None, None, 191, "")]),
        ("Body", "noun", "2", "corpse", [("Hml", 4, 2, None, 28, "")]),
        ("Bodykins", None, None, "", []),
        ("Boil", "verb", None, "to dress or cook in boiling water", [("Tp", 2, 1, None, 76, "")]),
        ("Boil", "verb", None, "to seethe", [("Tp", None, None, None, 12, "the sea b-s"), ("Wint", 3, 3, None, 64, "")]),
    ]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("goodly person, Tp. 1, 2, 415. 417. Ill, 1, 51. a bare b. Hml. III, 1, 76. V, 130.175 etc.", [("Tp", 1, 2, None, 415, "goodly person"), ("Tp", 1, 2, None, 417, ""), ("Tp", 3, 1, None, 51, ""), ("Hml", 3, 1, None, 76, "a bare b"), ("Hml", 5, None, None, 130, ""), ("Hml", 5, None, None, 175, "")]),
        ("Troil. Prol. 5.", [("Troil", None, None, "prologue", 5, "")]),
        ("H5 Chor. 3. so Tp. Epil. 1, 2. II, 1, 7", [("Tp", None, None, "epilogue", 1, "so"), ("Tp", None, None, "epilogue", 2, ""), ("Tp", 2, 1, None, 7, "")]),
        ("Ado V, 2, 4, 6. IXX, 9. Err. 3 IXL, 4", [("Ado", 2, 4, None, 6, ""), ("Err", None, None, None, 3, ""), ("Err", None, None, None, 4, "IXL")]),
        ("no reference V, here 12. and", []),
        ("", []),
        (None, []),
    ],
)
def test_references_go_on(spark, text, want):
    df = spark.createDataFrame([(1, text)], "k int, text string")
    assert [tuple(r)[2:] for r in dic.first_citations(df, ["k"]).orderBy("c").collect()] == want


def test_glosses_of_the_first(spark):
    cases = {"trans. a) to unclose": "to unclose", "to be tenderly affected; absol. = to be in love": "to be tenderly affected", "Used adjectively": "", "refl. pron.": "", "as in Tp. I, 2": "", "a tool (cf. Awl), ": "a tool"}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in df.select(dic.first_gloss(F.col("t"))).collect()] == list(cases.values())


def test_entries_and_senses_of_the_second(spark):
    assert told(dic.second_dictionary(book(spark, SECOND))) == [
        ("abase", None, None, "to lower", [("2H6", 1, 2, None, 15, "i. ii")]),  # the line "248  (Ff)." has too few letters and goes
        ("abate", None, "1", "to lessen, shorten", [("MND", 3, 2, None, 432, "Abate thy hours!")]),
        ("abate", None, "2", "to blunt, fig", [("2H4", 1, 1, None, 117, "his metal once in him abated"), ("R3", 5, 4, None, 48, "Abate the edge of traitors")]),
        ("bodkin", None, "1", "dagger", [("Ham", 3, 1, None, 76, "When he himself might his quietus make With a bare bodkin")]),
        ("bosky", None, None, "shrubby", [("Tp", 4, 1, None, 81, "My bosky acres")]),
        ("coil", None, "1", "noise, disturbance", [("Err", 3, 1, None, 48, "")]),
        ("coil", None, "2", "fuss, to-do", [("Ado", 3, 3, None, 99, "")]),
        ("coil", None, "2", "mortal coil, bustle or turmoil of this mortal life", [("Ham", 3, 1, None, 67, "this mortal coil")]),
    ]


def test_lines_more_and_parts_of_the_second(spark):
    lines = ["baste sb. : to sew Ham. iii. i. 169, 17l he b-d it, and 12 more Tp. Prol. 4, 5 so Ind. 3 b. it", "care occurs in phrases : worry Lr. i. i. 1", "2 not yet", "1 first Per. ii. n. 3", "2 next ; cf. Tim. i. i. 1, Tit. i. i. 2 ; last &c. Ven. 3"]
    assert told(dic.second_dictionary(book(spark, lines))) == [
        ("baste", "noun", None, "to sew", [("Ham", 3, 1, None, 169, ""), ("Ham", 3, 1, None, 171, "he basted it, and 12 more"), ("Tp", None, None, "prologue", 4, ""), ("Tp", None, None, "prologue", 5, "baste it")]),
        ("care", None, None, "worry", [("Lr", 1, 1, None, 1, ""), ("Lr", 1, 1, None, 2, "not yet")]),
        ("care", None, "1", "first", [("Per", 2, 2, None, 3, "")]),
        ("care", None, "2", "next", []),
        ("care", None, "2", "last", []),
    ]


def test_the_expected_number_gate(spark):
    df = spark.createDataFrame([([None, 2, 1, 1, 3, 2, None, 3],), ([],)], "ns array<int>")
    assert [r[0] for r in df.select(dic.expected_next(F.col("ns"))).collect()] == [[0, 0, 1, 1, 1, 2, 2, 3], []]


def test_asides_and_headwords(spark):
    asides = {"a (b {c) d} e) f": "a  e) f", "x) y (z": "x) y ", "": "", "no aside": "no aside"}
    df = spark.createDataFrame([(c,) for c in asides], "t string")
    assert [r[0] for r in df.select(dic.without_asides(F.col("t"))).collect()] == list(asides.values())
    quotes = {"A. thy hours!": "Abate thy hours!", "a-d me of half my train": "abated me of half my train", "I would b. here": "I would b. here", "(a., A-s": "(abate, abates"}
    df = spark.createDataFrame([(c, "abate") for c in quotes], "t string, h string")
    assert [r[0] for r in df.select(dic.expanded(F.col("t"), F.col("h"))).collect()] == list(quotes.values())


def test_headwords_out_of_order_are_text(spark):
    keys = ["bob", "wye", "bocchus", "bode", "body"]
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate(keys)], "book int, p int, key string")
    assert sorted(r.p for r in dic.alphabetical(df, "book", "p", "key").collect()) == [0, 2, 3, 4]


def test_books_apart_and_empty_ones(spark):
    lines = book(spark, FIRST, [None, "", "12"], FIRST[::-1], SECOND)
    one = told(dic.first_dictionary(lines.where("book = 0")))
    assert told(dic.first_dictionary(lines.where("book <= 1"))) == one
    for scan in (dic.first_dictionary, dic.second_dictionary):
        assert scan(lines.limit(0)).collect() == [] and scan(lines.where("book = 1")).collect() == []
