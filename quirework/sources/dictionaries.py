"""Scans of two printed dictionaries from the text layer of their scanned pages.

The first begins an entry with a capital headword and a comma, numbers senses ``1) ... 2) ...`` and prints each
citation behind its quotation; the second begins one with a small headword, numbers senses ``1 ... 2 ...`` and
prints quotations behind their citations, the headword cut to a letter. Numbers go on in the play, act and scene
of the reference before them. Lines are rows ``book``, ``n`` (their order) and ``line``; null lines are blank.

What a token leaves to those behind it (play, act, scene, sense) and what it ends (a quotation, a list of numbers)
is told in the first dictionary a sense at a time, in its row, as a sense is short and its tokens are many; in the
second as the last value over a window of its entry's tokens, and as a run of tokens. The other kernel is the chain
of headwords in alphabetical order, over a book's candidate words. Empty tables give
empty results.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.kept import kept
from ..operators import order, sequences

# The dictionaries' abbreviations of works and of parts of speech, and misread ones.
FIRST_WORKS = {
    "Ado": "Ado", "All's": "All's", "All’s": "All's", "Ant": "Ant", "As": "As", "Caes": "Caes", "Compl": "Compl", "Cor": "Cor", "Cymb": "Cymb", "Err": "Err",
    "Gentl": "Gentl", "Gent": "Gentl", "H4A": "H4A", "H4B": "H4B", "H5": "H5", "H6A": "H6A", "H6B": "H6B", "HGB": "H6B", "H6C": "H6C", "H8": "H8", "Hml": "Hml",
    "John": "John", "LLL": "LLL", "Lr": "Lr", "Lucr": "Lucr", "Mcb": "Mcb", "Meas": "Meas", "Merch": "Merch", "Mids": "Mids", "Oth": "Oth", "Per": "Per",
    "Phoen": "Phoen", "Pilgr": "Pilgr", "R2": "R2", "R3": "R3", "Rom": "Rom", "Shr": "Shr", "Sonn": "Sonn", "Tim": "Tim", "Tit": "Tit", "Tp": "Tp",
    "Troil": "Troil", "Tw": "Tw", "Ven": "Ven", "Wint": "Wint", "Wiv": "Wiv",
}
SECOND_WORKS = (
    "Ado", "All'sW", "Ant", "AYL", "Caes", "Compl", "Cor", "Cym", "Err", "Gent", "1H4", "2H4", "H5", "1H6", "2H6", "3H6", "H8", "Ham", "John", "LLL", "Lr",
    "Lucr", "Mac", "Meas", "MerV", "MND", "Oth", "Per", "Phoen", "Pilgr", "R2", "R3", "Rom", "Shr", "Sonn", "Tim", "Tit", "Tp", "Troil", "TwN", "Ven", "Wint", "Wiv",
)
FIRST_PARTS = {"subst": "noun", "prepos": "preposition", "vb": "verb", "adj": "adjective", "adv": "adverb", "pron": "pronoun", "prep": "preposition", "conj": "conjunction", "interj": "interjection"}
SECOND_PARTS = {"sb": "noun", "vb": "verb", "adj": "adjective", "adv": "adverb", "prep": "preposition", "conj": "conjunction", "interj": "interjection", "int": "interjection", "pron": "pronoun"}
_FIRST_ACTS, _FIRST_MISREAD = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5}, ("lT1|Y", "IIIIV")
_SECTIONS = {"Prol": "prologue", "Epil": "epilogue"}
_SECOND_MISREAD = {"n": "ii", "u": "ii", "in": "iii", "m": "iii", "hi": "iii", "iu": "iii", "rv": "iv", "y": "v"}
_NOTES = r"(?i)^(?:used|adjectively|substantively|adverbially|followed|preceded|joined|omitted|placed|put|absol|elliptically|redundantly|inserted|in the sense|the art)(?![A-Za-z0-9_])"

_S = r"[\s\p{Z}]"
_CITATIONS = "array<struct<play:string,act:int,scene:int,part:string,line:int,quote:string>>"


def _lookup(values: dict, c: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[c]


def roman_first(c: Column) -> Column:
    """An act's numeral, I to V, whose capitals the scan may have misread (``Il``, ``IU``, ``HI``, ``TII``, ``Y``); null for anything else."""
    level = F.regexp_replace(F.translate(F.replace(F.replace(c, F.lit("H"), F.lit("II")), F.lit("U"), F.lit("II")), *_FIRST_MISREAD), "^IIII$", "III")
    return _lookup(_FIRST_ACTS, level)


def roman_second(c: Column) -> Column:
    """A numeral up to 15 whose small capitals the scan may have read as other letters (``n``, ``in``, ``m``, ``hi``, ``rv``); null for anything else."""
    low = F.translate(F.lower(c), "1|l", "iii")
    tens, ones = ("", "x"), ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")
    values = {t + o: 10 * i + j for i, t in enumerate(tens) for j, o in enumerate(ones) if 0 < 10 * i + j <= 15}
    return _lookup(values, F.coalesce(_lookup(_SECOND_MISREAD, low), low))


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{_S}+", " "))


def glued(rows: DataFrame, by: Sequence[str], at: str, line: str) -> DataFrame:
    """``by`` and ``text``: lines joined by spaces, a word cut by a hyphen at a line's end put together if the next line goes on in small letters."""
    following = F.lead(line).over(Window.partitionBy(*by).orderBy(at))
    cut = F.col(line).endswith("-") & following.rlike("^[a-z]")
    piece = F.when(following.isNull(), F.col(line)).when(cut, F.expr(f"substring({line}, 1, length({line}) - 1)")).otherwise(F.concat(line, F.lit(" ")))
    told = rows.where(F.col(line) != "").select(*by, at, piece.alias("_piece"))
    return told.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "_piece"))), lambda p: p["_piece"]), "").alias("text"))


def alphabetical(candidates: DataFrame, by: str, at: str, key: str) -> DataFrame:
    """Those of a book's candidates that are on a longest chain of keys that never falls: real headwords are in order, lines that look like one are not."""
    arrays.bounded(candidates.sparkSession)
    chain = arrays.by_row(lambda keys: sequences.rising(keys.as_py(), strict=False), pa.list_(pa.int32()), "array<int>")
    listed = candidates.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(at, *[c for c in candidates.columns if c not in (by, at)]))).alias("_rows"))
    told = listed.select(by, "_rows", chain(F.col(f"_rows.{key}")).alias("_on"))
    return told.select(by, F.inline(F.transform("_on", lambda i: F.get("_rows", i)))).select(*candidates.columns)


def _bodies(rows: DataFrame, starts: DataFrame, at: str, line: str) -> DataFrame:
    """``book``, ``entry``, ``at``, ``line``: rows from each start on, that of a start being its ``body``; rows before the first go."""
    marked = rows.join(starts.select("book", at, "body", F.lit(True).alias("_start")), ["book", at], "left")
    w = Window.partitionBy("book").orderBy(at)
    told = marked.withColumn("entry", F.count("_start").over(w).cast("int")).where("entry > 0")
    return told.select("book", "entry", at, F.when(F.col("_start"), F.col("body")).otherwise(F.col(line)).alias(line))


def _tokens(rows: DataFrame, by: Sequence[str], text: str, groups: Sequence[str], pattern: str) -> DataFrame:
    """``by``, ``t`` and the groups of each match of ``pattern`` in ``text``, null where a group has none; ``whole`` is the match."""
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(g) for i, g in enumerate(("whole", *groups))]
    dealt = rows.select(*by, F.posexplode(F.arrays_zip(*found)).alias("t", "_m"))
    return dealt.select(*by, "t", *[F.nullif(F.col(f"_m.{g}"), F.lit("")).alias(g) for g in ("whole", *groups)])


def _joined(value: Column) -> Column:
    """Values in the order of their tokens, by spaces; those that are null are left out."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("t", value.alias("v"))))), lambda x: x["v"]), " ")


# The first dictionary


def first_noise(line: Column) -> Column:
    """Page numbers, running heads, and lines of which less than two fifths are letters and that hold no reference."""
    letters = F.length(F.regexp_replace(line, "[^A-Za-z]", ""))
    sparse = (letters / F.nullif(F.length(line), F.lit(0)) < 0.4) & ~line.rlike(rf"\d+,{_S}*\d+")
    return line.rlike(r"^\d{1,4}$") | line.rlike(rf"^[A-Z][a-z'’-]+{_S}+\d{{1,4}}{_S}+[A-Z][a-z'’-]+$") | F.coalesce(sparse, F.lit(False))


def first_paragraphs(lines: DataFrame) -> DataFrame:
    """``book``, ``p``, ``text``: a blank line ends a paragraph unless a cut word waits for its end; noise ends none."""
    tidy = F.regexp_replace(F.regexp_replace(F.coalesce("line", F.lit("")), rf"^[|_`~»]{_S}*", ""), rf"{_S}*\|$", "")
    tidy = F.regexp_replace(tidy, f"^{_S}+|{_S}+$", "")
    w = Window.partitionBy("book").orderBy("n")
    rows = lines.select("book", "n", tidy.alias("line")).withColumn("blanks", F.count_if(F.col("line") == "").over(w)).where((F.col("line") != "") & ~first_noise(F.col("line")))
    same = (F.col("blanks") == F.lag("blanks").over(w)) | F.lag("line").over(w).endswith("-")
    told = order.islands(rows, ["book"], "n", F.coalesce(same, F.lit(False)), "p")
    return glued(told, ["book", "p"], "n", "line").select("book", F.col("p").cast("int").alias("p"), F.regexp_replace("text", f"{_S}+", " ").alias("text"))


def first_entries(lines: DataFrame) -> DataFrame:
    """``book``, ``entry``, ``headword``, ``part_of_speech``, ``body``."""
    paragraphs = kept(first_paragraphs(lines))
    head = rf"^([A-Z][A-Za-z'’-]*)(?:{_S}*\([^)]*\))?{_S}*[,:]{_S}+(.*)$"
    named = paragraphs.select("book", "p", F.regexp_extract("text", head, 1).alias("headword"), F.regexp_extract("text", head, 2).alias("body"))
    named = named.where((F.col("headword") != "") & ~F.col("headword").isin(*FIRST_WORKS)).withColumn("key", F.regexp_replace(F.lower("headword"), "[^a-z]", ""))
    starts = kept(alphabetical(named, "book", "p", "key"))
    number = starts.select("book", "headword", F.row_number().over(Window.partitionBy("book").orderBy("p")).alias("entry"))
    listed = F.array_sort(F.collect_list(F.struct("p", "text")))
    bodies = _bodies(paragraphs, starts, "p", "text").groupBy("book", "entry").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("body"))
    part = rf"^({'|'.join(FIRST_PARTS)})\.,?{_S}*"
    return bodies.join(number, ["book", "entry"]).select("book", "entry", "headword", _lookup(FIRST_PARTS, F.regexp_extract("body", part, 1)).alias("part_of_speech"), F.regexp_replace("body", part, "").alias("body"))


def first_gloss(gloss: Column) -> Column:
    """What a gloss means: without references, labels and notes of use; empty where it tells of grammar, or is a quotation."""
    told = F.regexp_replace(F.regexp_replace(gloss, r"\(cf\.[^)]*\)", ""), f"{_S}+", " ")
    told = F.regexp_replace(told, rf"(?i)^(?:(?:trans|intrans|intr|tr|refl|absol|impers|partic|pron|adj|adv|subst|vb|fem|masc)\.{_S}*|[a-z]\){_S}*)+", "")
    told = F.regexp_replace(told, rf"(?i)[;,]{_S}*(?:[a-z]\){_S}*)?(?:absol(?:utely|\.)?|trans\.|intrans\.|intr\.|tr\.).*$", "")
    told = F.trim(F.regexp_replace(told, rf"[\s\p{{Z}},;]+$", ""))
    empty = F.trim(gloss).rlike(_NOTES) | ~told.rlike(r"[A-Za-z]{3,}(?![.A-Za-z0-9_])") | told.rlike(rf"(?<![A-Za-z0-9_])[IVX]{{1,3}},{_S}*\d|\d+,{_S}*\d+")
    return F.when(empty, "").otherwise(told)


def first_senses(entries: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """``book``, ``entry``, the entry's columns ``also``, ``sense`` (from 0), ``label``, ``gloss``, ``text`` (its quotations and citations).

    A gloss runs to the first colon; ``Hence = ...:`` behind it begins a derived sense with the same label.
    """
    parts = entries.select("book", "entry", *also, F.posexplode(F.split("body", rf"(?:^|\n|,{_S})(?=\d{{1,2}}\){_S})")).alias("k", "part"))
    labelled = rf"(?s)^(\d{{1,2}})\){_S}+(.*)$"
    has = F.col("part").rlike(labelled)
    content = F.replace(F.when(has, F.regexp_extract("part", labelled, 2)).otherwise(F.col("part")), F.lit("\n"), F.lit(" "))
    told = parts.select("book", "entry", *also, "k", F.when(has, F.regexp_extract("part", labelled, 1)).alias("label"), content.alias("content")).withColumn("colon", F.instr("content", ":"))
    rest = F.when(F.col("colon") > 0, F.expr("substring(content, colon + 1)")).otherwise(F.col("content"))
    hence = rf"(?<![A-Za-z0-9_])Hence{_S}*={_S}*([^:]{{2,80}}):"
    told = told.withColumn("rest", rest).withColumn("first", F.expr("substring(content, 1, greatest(colon - 1, 0))"))
    glosses = F.concat(F.array("first"), F.regexp_extract_all("rest", F.lit(hence), F.lit(1)))
    dealt = told.select("book", "entry", *also, "k", "label", F.posexplode(F.arrays_zip(glosses.alias("gloss"), F.split("rest", hence).alias("text"))).alias("d", "s"))
    number = F.row_number().over(Window.partitionBy("book", "entry").orderBy("k", "d")) - 1
    return dealt.select("book", "entry", *also, number.alias("sense"), "label", first_gloss(F.col("s.gloss")).alias("gloss"), F.col("s.text").alias("text"))


#: ``_S`` as Python spells it.
_SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_FIRST_TOKEN = re.compile("|".join([
    rf"(?<![A-Za-z])(?=[{''.join({w[0] for w in FIRST_WORKS})}])(?P<work>{'|'.join(re.escape(w) for w in sorted(FIRST_WORKS, key=len, reverse=True))})(?![A-Za-z])\.?",
    r"(?<![A-Za-z0-9_])(?P<section>Prol|Epil|Chor)\.?",
    rf"(?<![A-Za-z0-9])(?=[1|]*[IVXlTHUY])(?P<roman>[IVXlTHUY1|]{{1,4}}),[{_SPACE}]*(?=\d)",
    rf"(?P<num>\d{{1,4}})[{_SPACE}]*(?P<sign>[,.;]?)",
    rf"(?P<word>[^{_SPACE}]+)",
]), re.ASCII)
# a next line that ends a text is no part of it
_FIRST_END = re.compile(r"[\s,;:.]+(?=\x85?\Z)", re.ASCII)


@cache
def _first_act(roman: str) -> int | None:
    """``roman_first`` of at most four signs."""
    return _FIRST_ACTS.get(roman.replace("H", "II").replace("U", "II").translate(str.maketrans(*_FIRST_MISREAD)).replace("IIII", "III"))


def _first_cited(text: str | None) -> list[tuple[str, int | None, int | None, str | None, int, str]]:
    """``play``, ``act``, ``scene``, ``part``, ``line``, ``quote`` of each reference, a token after the other."""
    told, numbers, words, quote, of = [], [], [], "", (None, None)
    play = part = act = scene = None
    placed, goes_on = True, False

    def end() -> None:
        """Ends a list of numbers: only the first behind a work or numeral says where, the others go on there."""
        nonlocal numbers, placed, act, scene
        if not placed and of[1] is None and len(numbers) == 3:
            act, scene, *numbers = numbers
        elif not placed and of[1] is None and len(numbers) > 1:
            scene, *numbers = numbers
        placed = True
        if of[0] is not None:
            told.extend((of[0], act, scene, of[1], n, "" if i else quote) for i, n in enumerate(numbers))
        numbers = []

    for token in _FIRST_TOKEN.finditer(text or ""):
        work, section, roman, num, sign, word = token.groups()
        if num:
            if not goes_on:
                if numbers:
                    end()
                quote, of, words = _FIRST_END.sub("", " ".join(words)) if words else "", (play, part), []
            numbers.append(int(num))
            goes_on = sign == ","
            continue
        goes_on = False
        if word:
            words.append(word)
            continue
        if numbers:
            end()
        value = roman and _first_act(roman)
        if work or value:
            play, part, act, scene, placed = FIRST_WORKS[work] if work else play, None, value, None, False
        elif section:
            play, part = None if section == "Chor" else play, _SECTIONS.get(section)
        else:
            play = None
    if numbers:
        end()
    return told


def first_cited(text: Column) -> Column:
    """``play``, ``act``, ``scene``, ``part``, ``line``, ``quote`` of each reference in a text; a quotation stands before its reference.

    The first numbers behind a work or a numeral give the place, later ones more lines of it: two or more are a scene
    and its lines, three without a numeral an act too, one behind a numeral the line of an act with one scene.
    """
    kinds = {c: pa.int32() if c in ("act", "scene", "line") else pa.string() for c in ("play", "act", "scene", "part", "line", "quote")}
    of = arrays.by_row(lambda x: _first_cited(x.as_py()), pa.list_(pa.struct(list(kinds.items()))), _CITATIONS)
    return of(text)


def first_citations(texts: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """``by``, ``c`` (from 0) and the columns of each reference."""
    arrays.bounded(texts.sparkSession)
    return texts.select(*by, F.posexplode(first_cited(F.col(text))).alias("c", "cite")).select(*by, "c", "cite.*")


# The second dictionary

_LINE = r"\d[\dlIO]{0,3}"
_NUMERAL = r"[ivxlnmhuyIVXL1|]{1,5}"


def second_noise(line: Column) -> Column:
    """Page numbers, running heads in capitals, and lines of which less than three tenths are letters."""
    letters = F.regexp_replace(line, "[^A-Za-z]", "")
    capitals = (letters != "") & (letters == F.upper(letters)) & ~line.rlike("[a-z]") & ~line.rlike(r"\d{2}")
    return line.rlike(rf"^[\d\s\p{{Z}}]{{1,5}}$") | capitals | ((line != "") & (F.length(letters) / F.greatest(F.length(line), F.lit(1)) < 0.3))


def second_entries(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``book``, ``entry``, ``headword``, ``part_of_speech``; and ``book``, ``entry``, ``n``, ``line`` of their bodies."""
    rows = lines.select("book", "n", _squeezed(F.col("line")).alias("line")).where((F.col("line") != "") & ~second_noise(F.col("line")))
    rows = kept(rows)
    head = (
        r"^([A-Za-z][a-z'’-]*(?: [a-z][a-z'’-]*){0,2})[\d¹²³]?((?:\s*,\s*[a-z][a-z'’-]*[\d¹²³]?)*)"
        rf"\s*(?:({'|'.join(SECOND_PARTS)})\.\s*[\d'’¹²³]?)?(?:\s+occurs(?![A-Za-z0-9_])[^:]*(?=:))?\s*(:|\(|\{{|$)"
    )
    got = lambda i: F.regexp_extract("line", head, i)
    named = rows.where(F.col("line").rlike(head)).select("book", "n", got(1).alias("headword"), got(3).alias("pos"), got(4).alias("sep"), F.regexp_replace("line", head, "").alias("rest"))
    works = [w.replace(" ", "") for w in SECOND_WORKS]
    named = named.where(~F.regexp_replace("headword", r"[.\s]", "").isin(*works)).select("book", "n", "headword", _lookup(SECOND_PARTS, F.col("pos")).alias("part_of_speech"), F.regexp_replace(F.lower("headword"), "[^a-z]", "").alias("key"), F.concat(F.when(F.col("sep").isin("(", "{"), "(").when(F.col("sep") == ":", ": ").otherwise(""), "rest").alias("body"))
    starts = kept(alphabetical(named, "book", "n", "key"))
    number = F.row_number().over(Window.partitionBy("book").orderBy("n"))
    return starts.select("book", number.alias("entry"), "headword", "part_of_speech"), _bodies(rows, starts, "n", "line")


def expected_next(numbers: Column) -> Column:
    """For an array of numbers, how often by each of them the next number was the one expected: 1, then 2, ...; others, and nulls, pass."""
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("so_far"))
    step = lambda a, x: F.struct((a["next"] + F.when(x == a["next"], 1).otherwise(0)).alias("next"), F.concat(a["so_far"], F.array(a["next"] - 1 + F.when(x == a["next"], 1).otherwise(0))).alias("so_far"))
    return F.aggregate(numbers, start, step, lambda a: a["so_far"])


def without_asides(text: Column) -> Column:
    """A text without what stands in round or curly brackets, one within another; an open one hides the rest, and a closing one alone stays."""
    pieces = F.regexp_extract_all(text, F.lit(r"[({]|[)}]|[^(){}]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("deep"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        opens, closes = x.isin("(", "{"), x.isin(")", "}") & (a["deep"] > 0)
        deep = a["deep"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        return F.struct(deep.alias("deep"), F.when(~opens & ~closes & (a["deep"] == 0), F.concat(a["out"], x)).otherwise(a["out"]).alias("out"))

    return F.aggregate(pieces, start, step, lambda a: a["out"])


def second_texts(bodies: DataFrame) -> DataFrame:
    """``book``, ``entry``, ``g``, ``label``, ``text``: the numbered parts of an entry, or what stands behind its colon, without asides, other references and notes."""
    numbered = r"^(\d{1,2})\s+(?=[a-z=('‘\"])(.*)$"
    told = bodies.select("book", "entry", "n", "line", F.regexp_extract("line", numbered, 1).try_cast("int").alias("number"), F.regexp_extract("line", numbered, 2).alias("rest"))
    listed = told.groupBy("book", "entry").agg(F.array_sort(F.collect_list(F.struct("n", "line", "number", "rest"))).alias("ls")).withColumn("gs", expected_next(F.transform("ls", lambda x: x["number"])))
    dealt = listed.select("book", "entry", F.inline(F.arrays_zip("ls", "gs"))).select("book", "entry", "ls.*", F.col("gs").alias("g"))
    w = Window.partitionBy("book", "entry").orderBy("n")
    begins = F.col("g") > F.coalesce(F.lag("g").over(w), F.lit(0))
    dealt = dealt.withColumn("begins", begins).withColumn("line", F.when(F.col("begins"), F.col("rest")).otherwise(F.col("line")))
    text = F.regexp_replace(without_asides(F.col("text")), r"\[[^\]]*\]", " ")
    text = F.regexp_replace(text, r"\s(?:%|¶|\^\[|\^J|-fj|•\s*\[\}?|•)\s.*$", "")
    parts = glued(dealt, ["book", "entry", "g"], "n", "line").withColumn("text", text)
    plain = F.col("g") == 0
    kept = parts.where(~plain | F.col("text").rlike(r"^\s*:\s*"))
    return kept.select("book", "entry", "g", F.when(~plain, F.col("g").cast("string")).alias("label"), F.when(plain, F.regexp_replace("text", r"^\s*:\s*", "")).otherwise(F.col("text")).alias("text"))


def expanded(text: Column, headword: Column) -> Column:
    """A quotation with its headword written out: ``A.`` and ``a-d`` of ``abate`` are ``Abate`` and ``abated``."""
    a, safe = F.lower(F.substring(headword, 1, 1)), F.regexp_replace(headword, r"([\\$])", r"\\$1")
    capital = F.concat(F.upper(a), F.substring(safe, 2, 1_000))
    told = F.regexp_replace(text, F.concat(F.lit(r"(^|[\s(])["), a, F.upper(a), F.lit(r"]-([a-z]{1,4})(?![A-Za-z0-9_])")), F.concat(F.lit("$1"), safe, F.lit("$2")))
    stop = F.lit(r"\.(?=[\s,;:!?]|$)")
    told = F.regexp_replace(told, F.concat(F.lit(r"(^|[\s(])"), F.upper(a), stop), F.concat(F.lit("$1"), capital))
    return F.regexp_replace(told, F.concat(F.lit(r"(^|[\s(])"), a, stop), F.concat(F.lit("$1"), safe))


def second_gloss(gloss: Column, headword: Column) -> Column:
    """What a gloss means: the headword written out, without labels before it and what leads on behind it; empty without three letters in a row."""
    told = F.regexp_replace(F.regexp_replace(expanded(gloss, headword), r"\s+", " "), r"^[\s=,;:—–-]+", "")
    told = F.regexp_replace(told, r"(?i)^(?:(?:adv|adj|sb|vb|intr|trans|tr|refl|absol|pl|pi|ppl|pple)\.\s*)+", "")
    told = F.regexp_replace(told, r"[\s,;:.&]+(?:&c)?[\s,;:.]*$", "")
    told = F.trim(F.regexp_replace(told, r"(?i)(?<![A-Za-z0-9_])(?:freq|usu|esp)\.?\s*$", ""))
    return F.when(told.rlike("[A-Za-z]{3,}"), told).otherwise("")


def second_senses(texts: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``by``, ``s`` (from 1), ``gloss``; and ``by``, ``s``, ``c``, ``play``, ``act``, ``scene``, ``part``, ``line``, ``quote`` of texts with ``text`` and ``headword``.

    Words before the first reference are the gloss, words behind a reference its quotation, and words behind a semicolon
    the gloss of a further sense. Lone numbers right behind a reference are more lines of it. What ``cf.`` compares, up to the
    next semicolon, is not cited. Senses with neither gloss nor citations go; ``s`` may have gaps.
    """
    spelled = sorted((r"\.?\s?".join(re.escape(c) for c in w) for w in SECOND_WORKS), key=len, reverse=True)
    pattern = "|".join([
        rf"(?<![A-Za-z0-9])({'|'.join(spelled)})(?![A-Za-z])\.?",
        rf"(?<![A-Za-z0-9_])(Prol|Epil|Chor|Ind)\.(?:\s*({_LINE})(?![A-Za-z0-9_]))?",
        rf"(?<![A-Za-z0-9_])({_NUMERAL})\.\s*({_NUMERAL})\.\s*({_LINE})(?![A-Za-z0-9_])",
        rf"(?<![A-Za-z0-9_.])({_LINE})(?![A-Za-z0-9_])(?!\.\s*[a-z])",
        r"(;)",
        r"([^\s;]+)",
    ])
    by = list(by)
    w = Window.partitionBy(*by).orderBy("t")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = _tokens(texts, by, "text", ("work", "section", "section_line", "a", "b", "c", "num", "semicolon", "word"), pattern)
    line = lambda c: F.when(F.translate(c, "lI|iOo", "111100").rlike(r"^\d{1,4}$"), F.translate(c, "lI|iOo", "111100").try_cast("int"))
    part = _lookup(_SECTIONS, F.col("section"))
    act, scene = roman_second(F.col("a")), roman_second(F.col("b"))
    full = F.col("a").isNotNull() & (act <= 5) & scene.isNotNull() & line(F.col("c")).isNotNull()
    in_part = part.isNotNull() & line(F.col("section_line")).isNotNull()
    rows = rows.select("*", F.coalesce(full, F.lit(False)).alias("full"), F.coalesce(in_part, F.lit(False)).alias("in_part"), part.alias("set_part"), act.alias("set_act"), scene.alias("set_scene"))
    rows = rows.withColumn("cf", F.coalesce(F.col("word").rlike(r"(?i)^cf\.?$"), F.lit(False)))
    rows = rows.withColumn("ends", F.col("work").isNotNull() | F.col("section").isNotNull() | F.col("full") | F.col("semicolon").isNotNull() | F.col("cf"))
    none = lambda kind: F.struct(F.lit(None).cast(kind).alias("v"))
    carried = lambda c: F.last(c, ignorenulls=True).over(w)["v"]
    play = F.when(F.col("work").isNotNull(), F.struct(F.regexp_replace("work", r"[.\s]", "").alias("v"))).when(F.col("section").isin("Chor", "Ind"), none("string"))
    in_section = F.when(F.col("section").isNotNull(), F.struct(F.col("set_part").alias("v"))).when(F.col("work").isNotNull() | F.col("full"), none("string"))
    place = F.when(F.col("full"), F.struct(F.struct(F.col("set_act").alias("act"), F.col("set_scene").alias("scene")).alias("v"))).when(F.col("work").isNotNull(), none("struct<act:int,scene:int>"))
    compares = F.when(F.col("cf"), F.struct(F.lit(True).alias("v"))).when(F.col("semicolon").isNotNull(), none("boolean"))
    rows = rows.select("*", carried(play).alias("play"), carried(in_section).alias("part"), carried(place).alias("place"), F.coalesce(carried(compares), F.lit(False)).alias("compares"))
    # a lone number is one more line if only signs stand between it and the last token that ends a run of words
    more = F.col("num").isNotNull() & line(F.col("num")).isNotNull() & F.col("play").isNotNull() & (F.col("place.act").isNotNull() | F.col("part").isNotNull())
    rows = rows.withColumn("more", F.coalesce(more, F.lit(False))).withColumn("said", ~F.col("ends") & ~F.col("more") & (F.regexp_replace("whole", r"[,\s]", "") != "")).withColumn("stretch", F.count_if("ends").over(w))
    plain = F.coalesce(F.count_if("said").over(Window.partitionBy(*by, "stretch").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 0
    rows = rows.withColumn("more", F.col("more") & plain).withColumn("settles", F.col("ends") | F.col("more"))
    rows = rows.withColumn("event", F.coalesce(F.count_if("settles").over(earlier), F.lit(0)) + 1)
    cited = F.when(F.col("full"), line(F.col("c"))).when(F.col("in_part"), line(F.col("section_line"))).when(F.col("more"), line(F.col("num")))
    # one row for each token that settles the words before it, and one for the end of the text
    words = F.trim(_joined(F.when(~F.col("settles"), F.when(F.col("num").isNotNull(), F.col("num")).otherwise(F.col("whole")))))
    at = lambda c: F.max(F.when(F.col("settles"), c))
    events = rows.groupBy(*by, "event").agg(words.alias("pending"), at(F.col("semicolon")).alias("semicolon"), at(cited).alias("line"), *[at(F.col(c)).alias(c) for c in ("play", "part", "place", "compares")])
    w = Window.partitionBy(*by).orderBy("event")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    opens = (F.col("event") == 1) | F.coalesce(F.lag("semicolon").over(w).isNotNull(), F.lit(False))
    events = events.withColumn("new", opens & (F.col("pending") != "") & ~F.col("pending").rlike(r"(?i)^cf(?![A-Za-z0-9_])"))
    events = events.withColumn("s", F.count_if("new").over(w)).withColumn("last_new", F.max(F.when(F.col("new"), F.col("event"))).over(w)).withColumn("cites", F.col("line").isNotNull())
    events = events.withColumn("good", F.col("cites") & F.col("play").isNotNull() & ~F.coalesce("compares", F.lit(False)) & (F.col("s") > 0)).withColumn("of", F.max(F.when(F.col("cites"), F.col("event"))).over(earlier))
    events = kept(events)
    quotes = events.where(~F.col("new") & (F.col("pending") != "") & (F.coalesce("last_new", F.lit(0)) <= F.col("of"))).groupBy(*by, F.col("of").alias("event")).agg(F.max_by("pending", "event").alias("quote"))
    heads = texts.select(*by, "headword")
    told = events.where("good").join(quotes, [*by, "event"], "left").join(heads, by)
    quote = F.regexp_replace(expanded(F.coalesce("quote", F.lit("")), F.col("headword")), r"[\s,;:.]+$", "")
    where = lambda c: F.col(f"place.{c}")
    c = F.row_number().over(Window.partitionBy(*by, "s").orderBy("event")) - 1
    citations = told.select(*by, F.col("s").cast("int").alias("s"), c.alias("c"), "play", where("act").alias("act"), where("scene").alias("scene"), "part", "line", quote.alias("quote"))
    senses = events.where("new").join(heads, by).select(*by, F.col("s").cast("int").alias("s"), second_gloss(F.col("pending"), F.col("headword")).alias("gloss"))
    used = senses.join(citations.select(*by, "s", F.lit(True).alias("_cited")).distinct(), [*by, "s"], "left").where("gloss <> '' or _cited").drop("_cited")
    return used, citations


def _told(entries: DataFrame, senses: DataFrame, citations: DataFrame, keys: list[str]) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct("c", "play", "act", "scene", "part", "line", "quote"))), lambda x: x.dropFields("c"))
    full = senses.join(citations.groupBy("book", "entry", *keys).agg(listed.alias("citations")), ["book", "entry", *keys], "left")
    named = full.withColumn("sense", F.row_number().over(Window.partitionBy("book", "entry").orderBy(*keys)) - 1)
    return entries.select("book", "entry", "headword", "part_of_speech").join(named.select("book", "entry", "sense", "label", "gloss", F.coalesce("citations", F.array().cast(_CITATIONS)).alias("citations")), ["book", "entry"], "left")


def first_dictionary(lines: DataFrame) -> DataFrame:
    """``book``, ``entry``, ``headword``, ``part_of_speech``, ``sense``, ``label``, ``gloss``, ``citations``: a row a sense, in order."""
    named = ["headword", "part_of_speech"]
    senses = first_senses(first_entries(lines), named)
    arrays.bounded(lines.sparkSession)
    return senses.select("book", "entry", *named, "sense", "label", "gloss", first_cited(F.col("text")).alias("citations"))


def second_dictionary(lines: DataFrame) -> DataFrame:
    """As ``first_dictionary``; entries without senses have one row without."""
    entries, bodies = second_entries(lines)
    texts = second_texts(bodies).join(entries.select("book", "entry", "headword"), ["book", "entry"])
    senses, citations = second_senses(texts, ["book", "entry", "g"])
    labelled = senses.join(texts.select("book", "entry", "g", "label"), ["book", "entry", "g"])
    return _told(entries, labelled, citations, ["g", "s"])
