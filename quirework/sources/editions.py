"""Scans of two kinds of marked-up editions of plays, from the events of ``markup.events``.

An edition becomes rows of nodes (spoken lines and stage directions) in reading order, each with its place, its
speech and its marks by offset. Which element an event lies in is a running count of what is open; nodes are
groupings of the events that say them. The one kernel joins a node's pieces: it collapses white space, composes
letters with marks that follow in another piece, and keeps the offsets of what began or stood between. Offsets
count characters. Files without a play, and empty tables, give no rows; elements of no known name are read through.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.kept import kept

MARKS = "array<struct<start:int,end:int,type:string>>"
_BUILT = f"struct<text:string,marks:{MARKS},places:array<struct<id:string,at:int>>>"
#: Stands for what could not be read.
GAP = "•"


def joined(parts: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int, str]], list[tuple[str, int]]]:
    """The text of pieces ``(kind, value)``, its marks, and where its places are.

    Kinds are ``text``, ``marked`` (a gap), ``open`` and ``close`` (of the type that is the value; the last one open closes, and
    all do at the end) and ``place``. Marks of one type that touch become one; places count before the text is trimmed.
    """
    text, opened, marks, places = "", [], [], []

    def add(piece: str) -> None:
        nonlocal text
        piece = re.sub(r"\s+", " ", piece)
        if piece[:1] == " " and text[-1:] in ("", " "):
            piece = piece[1:]
        if piece.isascii():
            text += piece
            return
        if text and unicodedata.category(piece[0]).startswith("M"):
            text, piece = text[:-1], text[-1] + piece
        text += unicodedata.normalize("NFC", piece)

    def close(at: int) -> None:
        kind, start = opened.pop(at)
        if len(text) > start:
            marks.append((start, len(text), kind))

    for kind, value in parts:
        if kind == "text":
            add(value or "")
        elif kind == "marked":
            opened.append(("gap", len(text)))
            add(GAP)
            close(-1)
        elif kind == "open":
            opened.append((value, len(text)))
        elif kind == "place":
            places.append((value, len(text)))
        elif any(k == value for k, _ in opened):
            close(max(i for i, (k, _) in enumerate(opened) if k == value))
    while opened:
        close(-1)
    lead, whole = len(text) - len(text.lstrip()), text.strip()
    merged: list[list] = []
    for start, end, kind in marks:
        a, b = max(0, start - lead), min(len(whole), end - lead)
        before = [m for m in merged if m[2] == kind and m[1] >= a]
        if a < b and before:
            before[-1][1] = max(before[-1][1], b)
        elif a < b:
            merged.append([a, b, kind])
    return whole, sorted(tuple(m) for m in merged), places


def _built(kinds: Column, values: Column) -> Column:
    def of(kinds: pa.Scalar, values: pa.Scalar) -> dict:
        text, marks, places = joined(zip(kinds.as_py(), values.as_py(), strict=True))
        return {"text": text, "marks": [dict(zip(("start", "end", "type"), m, strict=True)) for m in marks], "places": [{"id": i, "at": a} for i, a in places]}

    mark, place = (pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string())]), pa.struct([("id", pa.string()), ("at", pa.int32())]))
    return arrays.by_row(of, pa.struct([("text", pa.string()), ("marks", pa.list_(mark)), ("places", pa.list_(place))]), _BUILT)(kinds, values)


_START, _TEXT = "event = 'start'", "event = 'text'"


def _flow(past: bool = False, within: Window | None = None):
    """A file's events in order, up to each one or, if ``past``, before it."""
    w = within or Window.partitionBy("path").orderBy("at")
    return w.rowsBetween(Window.unboundedPreceding, -1) if past else w


def _is(event: str) -> Column:
    return F.col("event") == event


def _in(*tags: str, within: str = "within") -> Column:
    """Whether an element of ``tags`` is open, an event's own among them, as its ``within`` tells without a window."""
    return reduce(lambda a, b: a | b, [F.contains(F.col(within), F.lit(f" {t} ")) for t in tags])


def _open(what: Column, flow: Window | None = None) -> Column:
    """How many elements are open, an event's own among them, of which ``what`` holds."""
    what = F.coalesce(what, F.lit(False))
    return F.sum((what & _is("start")).cast("int")).over(_flow(within=flow)) - F.coalesce(F.sum((what & _is("end")).cast("int")).over(_flow(True, flow)), F.lit(0))


def _counted(what: Column, flow: Window | None = None) -> Column:
    """How many starts so far ``what`` holds of."""
    return F.sum((F.coalesce(what, F.lit(False)) & _is("start")).cast("int")).over(_flow(within=flow))


def _attribute(name: str) -> Column:
    return F.col("attributes")[name]


def _said(rows: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """``keys`` with ``said``: the plain text of their events, white space collapsed."""
    pieces = F.array_sort(F.collect_list(F.struct("at", text.alias("t"))))
    return rows.where(_TEXT).groupBy(*keys).agg(F.trim(F.regexp_replace(F.array_join(F.transform(pieces, lambda p: p["t"]), ""), r"\s+", " ")).alias("said"))


def _build(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``text``, ``marks``, ``places`` of pieces (``at``, ``turn``, ``piece``, ``value``)."""
    arrays.bounded(pieces.sparkSession)
    listed = F.array_sort(F.collect_list(F.struct("at", "turn", "piece", "value")))
    return pieces.groupBy(*keys).agg(listed.alias("parts")).select(*keys, _built(F.col("parts.piece"), F.col("parts.value")).alias("b")).select(*keys, "b.*")


def _pieces(rows: DataFrame, keys: list[str], *pieces: tuple[Column, str | Column, Column]) -> DataFrame:
    """A row for each piece ``(when, kind, value)`` that an event gives, in this order."""
    made = F.array(*[F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(turn).alias("turn"), (F.lit(kind) if isinstance(kind, str) else kind).alias("piece"), value.cast("string").alias("value"))) for turn, (when, kind, value) in enumerate(pieces)])
    return rows.select(*keys, "at", F.explode(F.filter(made, lambda p: p.isNotNull())).alias("_p")).select(*keys, "at", "_p.*")


# Transcriptions of early prints

#: What glyph references show, and headings of acts and scenes.
GLYPHS = {"char:EOLhyphen": "", "char:V": "V"}
ACT, SCENE = r"(?i)^act", r"(?i)^sc(?:o?e|œ)na"
_LETTER = ["opener", "closer", "salute", "signed", "dateline"]


def long_s(c: Column) -> Column:
    """Early spelling with ``s`` for the long one."""
    return F.replace(c, F.lit("ſ"), F.lit("s"))


def early_play(stream: DataFrame, title: str | None = None) -> DataFrame:
    """The events of one play a file, with ``level`` 0 for the play, ``within`` from it on and ``around``, the file's own ``within``: the first whose heading, or an act's first one, has ``title``.

    Plays are the ``play`` and ``text`` divisions of the body, or the body if it has none. Without ``title`` a file must hold
    just one; a file without the play is an error.
    """
    stream = kept(stream)
    # bodies and divisions tell where the plays are; the other events only learn it from their file's row
    divs = stream.where(F.col("tag").isin("body", "div")).withColumn("base", F.min(F.when((F.col("tag") == "body") & _is("start"), F.struct("at", "level"))).over(_flow())["level"])
    own = F.coalesce((F.col("tag") == "div") & (F.col("level") == F.col("base") + 1) & _attribute("type").isin("play", "text") & _in("body"), F.lit(False))
    plays = divs.where(own & _is("end")).select("path", F.row_number().over(_flow()).alias("play"), F.col("begun").alias("first"), F.col("at").alias("last"))
    found = divs.where("base is not null").groupBy("path").agg(F.min("base").alias("base")).join(plays, "path", "left").withColumn("play", F.coalesce("play", F.lit(0)))
    shown = ["path", "at", "event", "tag", "attributes", "text", "level", "begun", "within", "around"]

    def of(plays: DataFrame, events: DataFrame, *more: str) -> DataFrame:
        """Events of plays, with levels and tags from the play on."""
        met = events.where(_in("body")).join(plays.hint("shuffle_hash"), "path").where("play = 0 or at between first and last")
        told = met.withColumn("around", F.col("within")).withColumn("level", F.col("level") - F.col("base") - (F.col("play") > 0).cast("int"))
        return told.withColumn("within", F.expr("concat(' ', substring_index(trim(within), ' ', -(level + 1)), ' ')")).select(*shown, *more)

    paths = stream.where("at = 0").select("path")
    if title is None:
        found = kept(found)
        bad = found.groupBy("path").agg(F.max("play").alias("n")).where("n > 1").limit(1).collect()
        if bad:
            raise ValueError(f"{bad[0]['path']}: expected a single play, found {bad[0]['n']}")
        chosen = found
    else:
        heads = of(found, stream.where(_in("head")), "play").withColumn("head", _counted(F.col("tag") == "head"))
        heads = _said(heads.where("level <= 3"), ["path", "play", "head"], long_s(F.col("text")))
        order = F.row_number().over(Window.partitionBy("path", "play").orderBy("head"))
        named = heads.withColumn("turn", order).where(F.col("said").rlike(title) & (F.col("turn") <= 3)).groupBy("path").agg(F.min("play").alias("play"))
        chosen = kept(found.join(named, ["path", "play"], "left_semi"))
    lost = paths.join(chosen, "path", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"{lost[0]['path']}: no play matching {title}")
    return of(chosen, stream)


def early_scenes(play: DataFrame) -> DataFrame:
    """``path``, ``begun``, ``turn``, ``act``, ``act_heading``, ``kind``, ``no``, ``key``, ``heading``, ``editorial`` of a play's scenes.

    Divisions are what their headings say, as their types may be wrong; text under an act's heading is its first scene, a
    scene beside the acts belongs to the one before, and a play without divisions is one editorial scene.
    """
    first = Window.partitionBy("path", "level").orderBy("at")
    # the division that an element is a child of: the last one begun at the level above
    divs = play.where(f"{_START} and tag in ('div', 'body') and level <= 2").select("path", "at", "level", _attribute("type").alias("type"), _attribute("n").alias("printed"))
    child = play.where(_START).where(F.col("tag").isin("sp", "stage", "l", "p", "lg", "head")).select("path", "at", "tag", "level")
    above = divs.select("path", F.col("at").alias("div"), (F.col("level") + 1).alias("level"))
    both = child.withColumn("div", F.lit(None).cast("int")).unionByName(above.select("path", F.col("div").alias("at"), F.lit(None).cast("string").alias("tag"), "level", "div"))
    held = both.withColumn("div", F.last("div", ignorenulls=True).over(first)).where("tag is not null and div is not null")
    spoken = held.groupBy("path", "div").agg(F.bool_or(F.col("tag").isin("sp", "stage", "l", "p", "lg")).alias("speaks"), F.bool_or(F.col("tag").isin("sp", "stage")).alias("plain"), F.min(F.when(F.col("tag") == "head", F.col("at"))).alias("head"))
    heads = _said(play.where(_in("head", within="around") & _in("head")).withColumn("head", F.last(F.when(_is("start") & (F.col("tag") == "head"), F.col("at")), ignorenulls=True).over(_flow())), ["path", "head"], long_s(F.col("text")))
    told = divs.join(spoken, [divs["path"] == spoken["path"], divs["at"] == spoken["div"]], "left").select(divs["*"], "speaks", "plain", "head").join(heads, ["path", "head"], "left").withColumnRenamed("said", "heading")
    kind = F.when(F.col("type").isin("epilogue", "prologue"), F.col("type")).when(F.col("heading").rlike(ACT), "act").when(F.col("heading").rlike(SCENE), "scene").when(F.col("type").isin("act", "scene"), F.col("type"))
    undivided = F.max(F.when((F.col("level") == 0) & F.col("plain"), True)).over(Window.partitionBy("path"))
    told = kept(told.withColumn("undivided", F.coalesce(undivided, F.lit(False))).withColumn("kind", F.when((F.col("level") == 2) & ~F.coalesce(kind.isin("scene", "epilogue", "prologue"), F.lit(False)), "scene").otherwise(kind)))
    w = Window.partitionBy("path").orderBy("at")
    is_act = (F.col("level") == 1) & (F.col("kind") == "act")
    # an act of its own for a prologue or epilogue beside the acts
    group = F.when(F.col("level") == 1, F.when(is_act | F.col("kind").isin("prologue", "epilogue"), F.struct("at", F.when(is_act, F.col("heading")).alias("heading"), is_act.alias("real"))))
    in_other = F.last(F.when(F.col("level") == 1, F.struct(F.col("kind").alias("k"))), ignorenulls=True).over(w)["k"].isNotNull()
    told = told.where("level > 0 and not undivided").withColumn("known", in_other).where("known").withColumn("group", F.last(group, ignorenulls=True).over(w)).withColumn("act", F.when(F.col("group.real"), F.sum(is_act.cast("int")).over(w)))
    scenes = told.where(((F.col("level") == 1) & is_act & F.coalesce("speaks", F.lit(False))) | (F.col("level") == 2) | ((F.col("level") == 1) & (F.col("kind") != "act")))
    own_text = F.col("own_text")
    scenes = scenes.withColumn("own_text", (F.col("level") == 1) & is_act)
    scenes = scenes.withColumn("kind", F.when(own_text, "scene").otherwise(F.col("kind"))).withColumn("heading", F.when(~own_text, F.col("heading")))
    number = F.sum((F.col("kind") == "scene").cast("int")).over(Window.partitionBy("path", "group.at").orderBy("at"))
    printed = F.when((F.col("type") == "scene") & ~own_text, F.col("printed").try_cast("int"))
    scenes = scenes.withColumn("no", F.when(F.col("kind") == "scene", F.greatest(number, F.coalesce(printed, number))))
    lone = play.where(f"{_START} and tag in ('div', 'body') and level = 0").groupBy("path").agg(F.min("at").alias("at")).join(divs.join(spoken, [divs["path"] == spoken["path"], divs["at"] == spoken["div"]]).where("level = 0 and plain").select(divs["path"]), "path", "left_semi")
    whole = lone.select("path", F.col("at").alias("begun"), F.lit(1).alias("act"), F.lit(None).cast("string").alias("act_heading"), F.lit("scene").alias("kind"), F.lit(1).alias("no"), F.lit(None).cast("string").alias("heading"), F.lit(True).alias("editorial"))
    parts = scenes.select("path", F.col("at").alias("begun"), F.col("act").cast("int").alias("act"), F.col("group.heading").alias("act_heading"), "kind", F.col("no").cast("int").alias("no"), "heading", F.lit(False).alias("editorial"))
    key = F.when(F.col("kind") == "scene", F.concat(F.col("act").cast("string"), F.lit("."), F.col("no").cast("string"))).when(F.col("act").isNull(), F.col("kind")).otherwise(F.concat(F.col("act").cast("string"), F.lit("."), F.col("kind")))
    told = parts.unionByName(whole).withColumn("turn", F.row_number().over(Window.partitionBy("path").orderBy("begun")) - 1).withColumn("key", key)
    return kept(told)


def early_nodes(play: DataFrame, scenes: DataFrame) -> DataFrame:
    """``path``, ``scene`` (its turn), ``idx``, ``kind`` (``line`` or ``sd``), ``text``, ``marks``, ``form``, ``sd_type``, ``inline_at``, ``speech``, ``label``, ``pages``.

    Directions within a line stand before it if it has not begun, else behind it, with the offset if the line goes on. What
    cannot be read is a marked gap. ``pages`` are the breaks ``(page, offset)`` before or in the node. ``speech`` numbers runs of one
    speaker: after everyone leaves, and after an entrance behind an exit, what a speech goes on with is another's, without label.
    """
    tags = lambda *names: F.col("tag").isin(*names)
    # only quotations and letters are asked for texts of their own, so no other event is joined
    some = tags("q", "floatingText", "body")
    # events that open, close or say nothing that a node is made of are not moved
    opens = some | tags("stage", "head", "l", "p", "g", "lg", "hi", *_LETTER)
    skipped = _in("note", "desc", "trailer", "speaker")
    nodes = ["stage", "head", "l", "p", "q", "floatingText", "body", *_LETTER]
    matter = (_is("text") & ~skipped & _in(*nodes)) | F.coalesce(opens | (tags("sp", "div", "pb", "gap") & _is("start")), F.lit(False))
    # asked of the file's tags too, where it is told before events are moved
    in_nodes = F.col("around").rlike(f" body .*?(?:{'|'.join(nodes)}) ")
    matter = matter & (~_is("text") | in_nodes)
    direct = play.where((F.col("event") == "text") & F.col("text").rlike(r"\S") & F.col("within").rlike(" (?:q|floatingText|body) $")).select("path", "begun", F.lit(True).alias("direct")).distinct()
    rows = play.where(matter & ~F.coalesce(some, F.lit(False))).withColumn("direct", F.lit(False)).unionByName(play.where(some).join(direct, ["path", "begun"], "left"))
    # scenes stand among the events, before that with which they begin
    begin = scenes.select("path", F.col("begun").alias("at"), F.col("turn").alias("begins"), F.lit(0).alias("late"))
    rows = rows.withColumn("late", F.lit(1)).unionByName(begin, allowMissingColumns=True)
    flow = Window.partitionBy("path").orderBy("at", "late")
    opened, counted = (lambda what: _open(what, flow)), (lambda what: _counted(what, flow))
    # a division that is no scene, such as a list of actors, ends the one before
    ends = F.max(F.when(_is("start") & (F.col("tag") == "div") & (F.col("level") == 1), F.col("at"))).over(flow)
    last = F.last(F.when(F.col("late") == 0, F.struct("at", "begins")), ignorenulls=True).over(flow)
    rows = rows.withColumn("_last", last).withColumn("_ends", ends).withColumn("sp", counted(F.col("tag") == "sp")).where("late = 1")
    rows = rows.withColumn("scene", F.when(F.col("_last.at") >= F.coalesce("_ends", F.lit(-1)), F.col("_last.begins"))).drop("_last", "_ends")
    placed, quoted = F.col("scene").isNotNull(), _in("sp", "lg", "floatingText")
    stage = placed & (tags("stage") | (tags("head") & quoted))
    line = placed & (tags("l", "p", *_LETTER) | (some & quoted & F.col("direct")))
    rows = rows.withColumn("in_sp", _in("sp")).withColumn("skipped", skipped)
    ref = _attribute("ref")
    punc = (F.col("tag") == "g") & (ref == "char:punc")
    shown = (F.col("tag") == "g") & ref.isin(*GLYPHS)
    rows = rows.withColumn("stages", opened(stage)).withColumn("lines", opened(line)).withColumn("in_glyph", opened(placed & (punc | shown)) > 0).withColumn("songs", opened(placed & (F.col("tag") == "lg") & (_attribute("type") == "song")))
    first = lambda n, what: F.coalesce(what & _is("start") & (F.col(n) == 1), F.lit(False))
    rows = rows.withColumn("stage_first", first("stages", stage)).withColumn("line_first", first("lines", line) & (F.col("stages") == 0))
    rows = rows.withColumn("stage_no", F.sum(F.col("stage_first").cast("int")).over(flow)).withColumn("line_no", F.sum(F.col("line_first").cast("int")).over(flow))
    in_stage, in_line = F.col("stages") > 0, F.col("lines") > 0
    live = ~F.col("skipped") | F.coalesce(F.col("tag") == "gap", F.lit(False))
    page = _is("start") & F.coalesce(F.col("tag") == "pb", F.lit(False))
    rows = rows.where(page | (placed & (in_stage | in_line) & (live | F.col("stage_first") | F.col("line_first"))))
    rows = kept(rows.select("path", "at", "event", "tag", "attributes", "text", "scene", "sp", "in_sp", "skipped", "stages", "lines", "in_glyph", "songs", "stage_first", "line_first", "stage_no", "line_no"))
    breaks = rows.where(page & (~placed | ~(in_stage | in_line)) & _attribute("n").isNotNull()).select("path", F.col("at").alias("pb"), _attribute("n").alias("page"))
    rows = rows.where(placed & (in_stage | in_line))
    is_hi = F.col("tag") == "hi"
    mark = F.when(_attribute("rend") == "sup", "sup").otherwise("italic")
    glyph = F.create_map(*[F.lit(x) for pair in GLYPHS.items() for x in pair])[ref]
    inner = [
        (is_hi & _is("start"), "open", mark),
        (_is("start") & (punc | (F.col("tag") == "gap")), "marked", F.lit(None)),
        (_is("start") & shown, "text", glyph),
        (_is("text") & ~F.col("in_glyph"), "text", long_s(F.col("text"))),
        (_is("start") & (F.col("tag") == "pb") & _attribute("n").isNotNull(), "place", F.concat(F.lit("p"), F.col("at").cast("string"), F.lit(" "), _attribute("n"))),
        (is_hi & _is("end"), "close", mark),
    ]
    # an event is one piece, and a line in a song within a song one more
    free, song = F.col("stages") == 0, F.col("line_first") & (F.col("songs") > 0)
    only = lambda pieces: [reduce(lambda told, p: told.when(p[0], p[n] if n == 2 else F.lit(p[n])), pieces[1:], F.when(pieces[0][0], pieces[0][n] if n == 2 else F.lit(pieces[0][n]))) for n in (1, 2)]
    held = lambda rows, key, pieces: rows.select("path", key, "at", F.lit(0).alias("turn"), *[c.cast("string").alias(n) for c, n in zip(only(pieces), ("piece", "value"), strict=True)]).where("piece is not null")
    sung, here = (song, "open", F.lit("song")), (F.col("stage_first") & in_line, "place", F.concat(F.lit("s"), F.col("stage_no").cast("string")))
    spoken = rows.where(in_line & live & (free | F.col("stage_first")))
    said = held(spoken, "line_no", [sung, here, *[(w & free, k, v) for w, k, v in inner]]).unionByName(spoken.where(song & (F.col("songs") > 1)).select("path", "line_no", "at", F.lit(1).alias("turn"), F.lit("open").alias("piece"), F.lit("song").alias("value")))
    directed = held(rows.where(in_stage & live), "stage_no", inner)
    lines = _build(said, ["path", "line_no"]).where("text <> ''")
    stages = _build(directed, ["path", "stage_no"])
    # where nodes begin, in which scene and speech
    line_at = rows.where("line_first").select("path", "line_no", "at", "scene", F.when(F.col("in_sp"), F.col("sp")).alias("sp"), F.when(F.col("tag") == "l", "verse").otherwise("prose").alias("form"))
    stage_at = rows.where("stage_first").select("path", "stage_no", "at", "scene", F.when(F.col("in_sp"), F.col("sp")).alias("sp"), F.when(F.col("tag") == "head", "label").alias("sd_type"), F.when(in_line, F.col("line_no")).alias("line_no"))
    pages = lambda: F.transform(F.filter("places", lambda p: p["id"].startswith("p")), lambda p: F.struct(F.substring_index(p["id"], " ", -1).alias("page"), p["at"].alias("offset")))
    lines = kept(line_at.join(lines, ["path", "line_no"]))
    stages = stage_at.join(stages, ["path", "stage_no"], "left").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("marks", F.coalesce("marks", F.array().cast(MARKS)))
    offsets = lines.select("path", "line_no", F.length("text").alias("size"), F.col("at").alias("line_at"), F.explode("places").alias("p")).where(F.col("p.id").startswith("s")).select("path", F.substring("p.id", 2, 20).cast("long").alias("stage_no"), "size", "line_at", F.col("p.at").alias("offset"))
    stages = stages.join(offsets, ["path", "stage_no"], "left")
    place = F.struct(F.coalesce("line_at", "at").alias("a"), F.when(F.col("offset") == 0, -1).when(F.col("offset") > 0, 1).otherwise(0).alias("b"), F.col("at").alias("c"))
    told = lines.select("path", "scene", "sp", F.struct(F.col("at").alias("a"), F.lit(0).alias("b"), F.col("at").alias("c")).alias("place"), F.lit("line").alias("kind"), "text", "marks", "form", F.lit(None).cast("string").alias("sd_type"), F.lit(None).cast("int").alias("inline_at"), pages().alias("pages")).unionByName(
        stages.select("path", "scene", "sp", place.alias("place"), F.lit("sd").alias("kind"), "text", "marks", F.lit(None).cast("string").alias("form"), "sd_type", F.when((F.col("offset") > 0) & (F.col("offset") < F.col("size")), F.col("offset")).alias("inline_at"), F.when(F.col("places").isNotNull(), pages()).alias("pages"))
    )
    flow = Window.partitionBy("path").orderBy("place")
    told = kept(told.withColumn("idx", F.row_number().over(flow) - 1))
    # breaks between nodes go to the next node
    loose = breaks.select("path", F.struct(F.col("pb").alias("a"), F.lit(0).alias("b"), F.col("pb").alias("c")).alias("place"), "page").unionByName(told.select("path", "place", "idx"), allowMissingColumns=True)
    # seen from the end, as a frame that reaches to the end is read again for every row
    back = Window.partitionBy("path").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    nearest = loose.withColumn("next", F.last("idx", ignorenulls=True).over(back)).where("page is not null and next is not null").groupBy("path", F.col("next").alias("idx")).agg(F.max_by("page", "place.a").alias("page"))
    none = F.array().cast("array<struct<page:string,offset:int>>")
    told = told.join(nearest, ["path", "idx"], "left").withColumn("pages", F.concat(F.when(F.col("page").isNotNull(), F.array(F.struct("page", F.lit(0).alias("offset")))).otherwise(none), F.coalesce("pages", none))).drop("page", "place")
    labels = _said(play.where(_in("speaker", within="around") | ((F.col("tag") == "sp") & _is("start"))).withColumn("sp", _counted(F.col("tag") == "sp")).where(_in("speaker")), ["path", "sp"], long_s(F.col("text"))).withColumnRenamed("said", "label")
    return _speeches(told.join(labels, ["path", "sp"], "left"))


def _speeches(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``speech``, null for directions outside speeches, and the ``label`` of its speaker."""
    w = Window.partitionBy("path", "sp").orderBy("idx")
    back = Window.partitionBy("path", "sp").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    begins = lambda c, words: F.coalesce(F.col(c).rlike(rf"(?i)^\s*(?:{words})(?![A-Za-z0-9_])"), F.lit(False))
    rows = nodes.withColumn("_before", F.when(F.lag("kind").over(w) == "sd", F.lag("text").over(w))).withColumn("_next", F.lead("kind").over(w)).withColumn("_more", F.coalesce(F.max(F.when(F.col("kind") == "line", F.lit(True))).over(back), F.lit(False)))
    in_sp, sd = F.col("sp").isNotNull(), F.col("kind") == "sd"
    enters = in_sp & sd & begins("text", "enter") & begins("_before", "exit|exeunt") & F.col("_more")
    leaves = in_sp & sd & begins("text", "exeunt") & (F.col("_next") == "line") & ~enters
    rows = rows.withColumn("_enters", enters).withColumn("_leaves", F.coalesce(leaves, F.lit(False)))
    cut = F.col("_enters") | F.coalesce(F.lag("_enters").over(w) | F.lag("_leaves").over(w), F.lit(False))
    rows = rows.withColumn("_part", F.when(in_sp, F.sum(cut.cast("int")).over(w)))
    spoken = F.max(F.when(F.col("kind") == "line", F.lit(True))).over(Window.partitionBy("path", "sp", "_part"))
    rows = rows.withColumn("_label", F.when(in_sp & (F.col("_part") == 0), F.coalesce("label", F.lit(""))).otherwise("")).withColumn("_block", F.when(in_sp & F.coalesce(spoken, F.lit(False)), F.struct("sp", "_part")))
    # lines outside speeches share a block without label with lines right before them
    flow = Window.partitionBy("path").orderBy("idx")
    loose = ~in_sp & (F.col("kind") == "line")
    rows = rows.withColumn("_loose", loose).withColumn("_speaks", F.col("_block").isNotNull() | F.col("_loose"))
    joins = F.col("_loose") & F.lag("_speaks").over(flow) & (F.lag("_label").over(flow) == "") & (F.lag("scene").over(flow) == F.col("scene"))
    same = F.col("_block").isNotNull() & F.lag("_block").over(flow).eqNullSafe(F.col("_block"))
    rows = rows.withColumn("_b", F.when(F.col("_speaks"), (~F.coalesce(joins | same, F.lit(False))).cast("int")))
    rows = rows.withColumn("speech", F.when(F.col("_speaks"), (F.sum("_b").over(flow) - 1).cast("int"))).withColumn("label", F.when(F.col("_speaks"), F.col("_label")))
    return rows.select("path", "scene", "idx", "kind", "text", "marks", "form", "sd_type", "inline_at", "speech", "label", "pages")


# Modern editions with words and line milestones

_SKIPPED = ["lb", "pb", "fw", "anchor", "ptr", "app", "note"]


def character_id(c: Column) -> Column:
    """``#SPIRITS.Juno_Tmp`` as ``spirits-juno``."""
    told = F.lower(F.regexp_replace(F.regexp_replace(c, "^#", ""), "_[A-Za-z0-9]+$", ""))
    return F.regexp_replace(F.regexp_replace(told, "[^a-z0-9]+", "-"), "^-|-$", "")


def characters(stream: DataFrame) -> DataFrame:
    """``path``, ``turn``, ``id``, ``name`` of the persons an edition lists; members of groups are named from their ids."""
    rows = stream.withColumn("person", F.last(F.when(_is("start") & F.col("tag").isin("person", "personGrp"), F.struct(F.col("at").alias("turn"), _attribute("id").alias("id"), F.col("tag").alias("tag"))), ignorenulls=True).over(_flow())).withColumn("inside", _open(F.col("tag").isin("person", "personGrp")) > 0)
    rows = rows.where("inside and person.id is not null").withColumn("named", _open(F.col("tag") == "name")).withColumn("called", _open(F.col("tag") == "persName"))
    listed = rows.select("path", "person").distinct()
    name = lambda c: _said(rows.where(f"{c} > 0"), ["path", "person"], F.col("text")).withColumnRenamed("said", c)
    own = F.filter(F.split(F.regexp_replace("person.id", "_[A-Za-z0-9]+$", ""), r"\."), lambda p: p != "0")
    made = F.array_join(F.transform(own, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1000)))), " ")
    told = listed.join(name("named"), ["path", "person"], "left").join(name("called"), ["path", "person"], "left")
    told = told.select("path", "person.turn", "person.tag", character_id(F.col("person.id")).alias("id"), F.coalesce("named", "called", made).alias("name"))
    # of an id given twice the last name counts, in the first one's place
    last = told.groupBy("path", "id").agg(F.min(F.struct("tag", "turn")).alias("f"), F.max_by("name", F.struct("tag", "turn")).alias("name"))
    return last.select("path", F.row_number().over(Window.partitionBy("path").orderBy("f.tag", "f.turn")).alias("turn"), "id", "name")


def modern_nodes(stream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes, and the tokens in them, of editions whose lines begin at milestones and whose text is in words, spaces and signs.

    Nodes: ``path``, ``idx``, ``act``, ``scene_kind``, ``no``, ``id``, ``kind``, ``text``, ``marks``, ``form``, ``part``, ``n``, ``sd_type``,
    ``inline_at``, ``sp``, ``speakers``, ``label``; tokens: ``path``, ``token``, ``id`` (of the node), ``start``, ``end``. Milestones of an older
    printing's lineation begin no line, quotation marks are supplied, by turns double and single, and a direction that
    the edition no longer has is none.
    """
    rows = stream
    tags = lambda *names: F.col("tag").isin(*names)
    division = lambda tag: F.last(F.when(_is("start") & (F.col("tag") == tag), F.struct(_attribute("type").alias("type"), _attribute("n").alias("n"), F.col("at").alias("at"))), ignorenulls=True).over(_flow())
    rows = rows.withColumn("div1", division("div1")).withColumn("div2", division("div2")).withColumn("in2", _open(tags("div2")) > 0).withColumn("skipped", _open(tags(*_SKIPPED)) > 0)
    rows = rows.where("div1 is not null and div1.type <> 'preface'").withColumn("inner", F.col("in2") & (F.col("div1.type") == "act"))
    rows = rows.withColumn("token", _open(tags("w", "c", "pc"))).withColumn("stages", _open(tags("stage", "label"))).withColumn("sp", _counted(tags("sp"))).withColumn("in_sp", _open(tags("sp")) > 0).withColumn("in_ab", (_open(tags("ab")) > 0) & F.col("in_sp"))
    lemma = _attribute("edRef").isNull() | F.contains(_attribute("edRef"), F.lit("#lemma"))
    mile = tags("milestone") & _is("start") & (_attribute("unit") == "ftln") & lemma & F.col("in_ab") & ~F.col("skipped")
    stage = tags("stage", "label") & _is("start") & (F.col("stages") == 1)
    rows = rows.withColumn("mile", mile).withColumn("stage", stage).withColumn("line_no", F.count_if("mile").over(_flow())).withColumn("stage_no", F.count_if("stage").over(_flow())).withColumn("ab", _counted(tags("ab")))
    began = F.last(F.when(F.col("mile"), F.col("ab")), ignorenulls=True).over(_flow())
    rows = rows.withColumn("in_line", F.coalesce(F.col("in_ab") & (began == F.col("ab")), F.lit(False)) & ~F.col("skipped"))
    quote = tags("q") | (tags("title") & (_attribute("rend") == "quotes"))
    mark = F.when(tags("seg") & (_attribute("type") == "song"), "song").when(tags("hi") & ((_attribute("rend") == "italic") | (F.col("token") > 0)), "italic").when(tags("foreign") & (F.col("token") == 0), "foreign")
    for name in ("song", "italic", "foreign"):
        rows = rows.withColumn(f"in_{name}", _open(mark == name) if name != "italic" else _open((mark == name) & (F.col("token") == 0)))
    rows = rows.withColumn("quotes", _open(quote & ~F.col("skipped") & (F.col("stages") == 0)))
    rows = kept(rows)
    in_token = F.col("token") > 0
    outer = tags("w", "c", "pc") & (F.col("token") == 1)
    spot = lambda side: F.concat(F.lit(side), _attribute("id"))
    inner = [
        (outer & _is("start") & _attribute("id").isNotNull(), "place", spot("<")),
        (in_token & (mark == "italic") & _is("start"), "open", F.lit("italic")),
        (in_token & tags("gap") & _is("start"), "marked", F.lit(None)),
        (in_token & _is("text"), "text", F.col("text")),
        (in_token & (mark == "italic") & _is("end"), "close", F.lit("italic")),
        (outer & _is("end") & _attribute("id").isNotNull(), "place", spot(">")),
    ]
    even = F.col("quotes") % 2 == 1
    out = ~in_token
    opened = [(F.col("mile") & (F.col(f"in_{m}") > 0), "open", F.lit(m)) for m in ("song", "italic", "foreign")]
    around = [
        (out & quote & _is("start"), "text", F.when(even, "“").otherwise("‘")),
        (out & mark.isNotNull() & _is("start"), "open", mark),
        (out & mark.isNotNull() & _is("end"), "close", mark),
        (out & quote & _is("end"), "text", F.when(even, "”").otherwise("’")),
    ]
    here = [(F.col("stage"), "place", F.concat(F.lit("s"), F.col("stage_no").cast("string")))]
    free = F.col("stages") == 0
    said = _pieces(rows.where(F.col("in_line") & (free | F.col("stage"))), ["path", "line_no"], *opened, *here, *[(w & free, k, v) for w, k, v in around], *[(w & free, k, v) for w, k, v in inner])
    spaced = [(tags("lb") & _is("start"), "text", F.lit(" "))]
    directed = _pieces(rows.where((F.col("stages") > 0) & (~F.col("skipped") | tags("lb"))), ["path", "stage_no"], *spaced, *[(w & ~F.col("skipped"), k, v) for w, k, v in inner])
    lines, stages = _build(said, ["path", "line_no"]).where("text <> ''"), _build(directed, ["path", "stage_no"]).where("text <> ''")
    where = [F.when(F.col("div1.type") == "act", F.col("div1.n").try_cast("int")).alias("act"), F.when(F.col("inner"), F.col("div2.type")).otherwise(F.col("div1.type")).alias("type"), F.when(F.col("inner"), F.col("div2.n")).otherwise(F.col("div1.n")).try_cast("int").alias("no"), F.when(F.col("in_sp"), F.col("sp")).alias("sp"), "at"]
    word_n = rows.where((F.col("tag") == "w") & _is("start") & F.col("in_line")).where(_attribute("n").isNotNull()).groupBy("path", "line_no").agg(F.min_by(_attribute("n"), "at").alias("word_n"))
    form = F.when(_attribute("ana") == "#prose", "prose").otherwise("verse")
    before, after = _attribute("prev").isNotNull(), _attribute("next").isNotNull()
    part = F.when(before & after, "medial").when(after, "initial").when(before, "final")
    line_at = rows.where("mile").select("path", "line_no", *where, _attribute("id").alias("id"), form.alias("form"), part.alias("part"), _attribute("n").alias("n"))
    lines = line_at.join(lines, ["path", "line_no"]).join(word_n, ["path", "line_no"], "left").withColumn("n", F.coalesce("n", "word_n"))
    lines = kept(lines)
    sd_type = F.when(F.col("tag") == "label", "label").otherwise(_attribute("type"))
    stages = rows.where(F.col("stage") & ~F.col("skipped")).select("path", "stage_no", *where, _attribute("id").alias("id"), sd_type.alias("sd_type")).join(stages, ["path", "stage_no"])
    offsets = lines.select("path", F.length("text").alias("size"), F.col("at").alias("line_at"), F.explode("places").alias("p")).where(F.col("p.id").startswith("s")).select("path", F.substring("p.id", 2, 20).cast("long").alias("stage_no"), "size", "line_at", F.col("p.at").alias("offset"))
    stages = stages.join(offsets, ["path", "stage_no"], "left")
    stages = stages.withColumn("place", F.struct(F.coalesce("line_at", "at").alias("a"), F.when(F.col("offset") == 0, -1).when(F.col("offset") > 0, 1).otherwise(0).alias("b"), F.col("at").alias("c"))).withColumn("inline_at", F.when((F.col("offset") > 0) & (F.col("offset") < F.col("size")), F.col("offset")))
    lines = lines.withColumn("place", F.struct(F.col("at").alias("a"), F.lit(0).alias("b"), F.col("at").alias("c")))
    both = kept(lines.withColumn("kind", F.lit("line")).unionByName(stages.withColumn("kind", F.lit("sd")), allowMissingColumns=True))
    who = rows.where((F.col("tag") == "sp") & _is("start")).select("path", "sp", F.transform(F.filter(F.split(F.coalesce(_attribute("who"), F.lit("")), r"\s+"), lambda p: p != ""), character_id).alias("speakers"))
    labels = _said(rows.withColumn("_in", _open(tags("speaker")) > 0).where("_in"), ["path", "sp"], F.col("text")).withColumnRenamed("said", "label")
    kind = F.when(F.col("type") == "chorus", "prologue").when((F.col("type") == "act") & F.col("act").isNotNull(), "scene").otherwise(F.col("type"))
    told = both.join(who, ["path", "sp"], "left").join(labels, ["path", "sp"], "left").withColumn("scene_kind", kind).withColumn("idx", F.row_number().over(Window.partitionBy("path").orderBy("place")) - 1)
    nodes = told.select("path", "idx", "act", "scene_kind", F.when(F.col("scene_kind") == "scene", F.col("no")).alias("no"), "id", "kind", "text", "marks", "form", "part", "n", "sd_type", "inline_at", "sp", "speakers", F.when(F.col("sp").isNotNull(), F.coalesce("label", F.lit(""))).alias("label"))
    spots = both.select("path", "id", F.explode("places").alias("p")).where(F.col("p.id").rlike("^[<>]"))
    tokens = spots.groupBy("path", F.substring("p.id", 2, 1000).alias("token"), "id").agg(F.min(F.when(F.col("p.id").startswith("<"), F.col("p.at"))).alias("start"), F.max(F.when(F.col("p.id").startswith(">"), F.col("p.at"))).alias("end"))
    return nodes, tokens


def passages(stream: DataFrame, tokens: DataFrame) -> DataFrame:
    """``path``, ``passage``, ``kind``, ``description``, ``turn``, ``token``, ``id``, ``start``, ``end``: each token that an edition's emendation pointers name, with its place; null where the text has none."""
    rows = stream
    ptr = rows.where(f"{_START} and tag = 'ptr'").where(_attribute("type") == "emendation")
    ptr = ptr.select("path", _attribute("id").alias("passage"), F.regexp_replace(F.coalesce(_attribute("ana"), F.lit("")), "^#", "").alias("kind"), F.posexplode(F.filter(F.transform(F.split(F.coalesce(_attribute("target"), F.lit("")), r"\s+"), lambda t: F.regexp_replace(t, "^#", "")), lambda t: t != "")).alias("turn", "token"))
    named = rows.withColumn("kind", F.last(F.when(_is("start") & (F.col("tag") == "interp"), _attribute("id")), ignorenulls=True).over(_flow())).withColumn("_in", _open(F.col("tag") == "interp") > 0).where("_in")
    told = _said(named, ["path", "kind"], F.col("text")).withColumnRenamed("said", "description")
    return ptr.join(told, ["path", "kind"], "left").withColumn("description", F.coalesce("description", "kind")).join(tokens, ["path", "token"], "left").select("path", "passage", "kind", "description", "turn", "token", "id", "start", "end")
