"""Scans of marked-up editions: XML as a table of events in document order, and what windows over it give.

A task reads its files in pieces and keeps no tree but what is open; elements, plain texts and nodes are windows and groupings by ``path``.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENT = "path string, at int, event string, tag string, attributes map<string,string>, text string, level int, begun int, within string"
_ARROW = pa.schema([("path", pa.string()), ("at", pa.int32()), ("event", pa.string()), ("tag", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("level", pa.int32()), ("begun", pa.int32()), ("within", pa.string())])


def _events(path: str, content: bytes, piece: int) -> Iterator[tuple]:
    rows: list[tuple] = []
    local = lambda name: name.rsplit(":", 1)[-1]
    parser = expat.ParserCreate()
    parser.buffer_text = True
    opened: list[tuple] = [(None, None, None, " ")]
    count = 0

    def start(tag: str, own: dict) -> None:
        nonlocal count
        tag, own = local(tag), [(local(k), v) for k, v in own.items()]
        opened.append((count, tag, list(dict(own).items()), f"{opened[-1][3]}{tag} "))
        tell("start", tag, opened[-1][2], None)

    def tell(event: str, tag: str | None, own: list | None, text: str | None) -> None:
        nonlocal count
        rows.append((path, count, event, tag, own, text, len(opened) - 1, opened[-1][0], opened[-1][3]))
        count += 1

    def end(_: str) -> None:
        tell("end", opened[-1][1], opened[-1][2], None)
        opened.pop()

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda text: tell("text", None, None, text)
    for begin in range(0, len(content) + 1, piece):
        parser.Parse(content[begin : begin + piece], begin + piece > len(content))
        yield from rows
        rows.clear()


def events(files: DataFrame, piece: int = 1 << 20, batch: int = 5_000) -> DataFrame:
    """``path``, ``at``, ``event`` (start, end or text), ``tag``, ``attributes``, ``text`` of XML files (``path``, ``content``), and where that is.

    ``level`` is how many elements are open, an event's own among them, ``within`` their tags between blanks, and ``begun`` where
    the innermost began. An element's attributes are at its end too. Names come without prefixes; comments and instructions
    go. Empty and null contents have no events; XML that is not well formed raises.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tell = lambda held: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)
        for rows in batches:
            for path, content in zip(rows["path"], rows["content"], strict=True):
                held: list[tuple] = []
                for row in _events(path.as_py(), content.as_py(), piece) if content.is_valid and len(content.as_py()) else ():
                    held.append(row)
                    if len(held) == batch:
                        yield tell(held)
                        held = []
                if held:
                    yield tell(held)

    return files.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(of, EVENT)


def _depth(tags: list[str]) -> Column:
    """How many elements of ``tags`` are open at an event, its own among them."""
    w = Window.partitionBy("path").orderBy("at")
    own = F.col("tag").isin(tags)
    opened = F.sum(F.when(own & (F.col("event") == "start"), 1).otherwise(0)).over(w)
    closed = F.sum(F.when(own & (F.col("event") == "end"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return opened - F.coalesce(closed, F.lit(0))


def nodes(stream: DataFrame, kinds: dict[str, str], within: dict[str, tuple[str, str]] | None = None, skip: list[str] | None = None) -> DataFrame:
    """``path``, ``idx``, ``kind``, ``attributes``, ``text``, and a column for each of ``within``: the outermost elements of the tags in ``kinds``, in order.

    ``text`` is what the element and its descendants say, white space collapsed, without elements of the tags in
    ``skip``. ``within`` maps a column to a tag and attribute: its value in the outermost open element of that tag, else null.
    """
    w = Window.partitionBy("path").orderBy("at")
    tags = list(kinds)
    df = stream.withColumn("_d", _depth(tags)).withColumn("_skip", _depth(skip) if skip else F.lit(0))
    first = F.col("tag").isin(tags) & (F.col("event") == "start") & (F.col("_d") == 1)
    df = df.withColumn("_first", first).withColumn("_k", F.sum(F.when(first, 1).otherwise(0)).over(w))
    for name, (tag, attribute) in (within or {}).items():
        df = df.withColumn("_o", _depth([tag]))
        begun = (F.col("tag") == tag) & (F.col("event") == "start") & (F.col("_o") == 1)
        # an element without the attribute hides that of the one before
        value = F.last(F.when(begun, F.struct(F.col("attributes")[attribute].alias("v"))), True).over(w)["v"]
        df = df.withColumn(name, F.when(F.col("_o") > 0, value)).drop("_o")
    said = F.array_sort(F.collect_list(F.when((F.col("event") == "text") & (F.col("_skip") == 0), F.struct("at", "text"))))
    text = F.trim(F.regexp_replace(F.array_join(F.transform(said, lambda p: p["text"]), ""), r"\s+", " "))
    of = lambda c: F.min_by(c, "at")
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    told = df.where("_d > 0").groupBy("path", "_k").agg(of("tag").alias("_tag"), of("attributes").alias("attributes"), text.alias("text"), *[of(n).alias(n) for n in within or {}])
    return told.select("path", (F.col("_k") - 1).cast("int").alias("idx"), F.element_at(kind, F.col("_tag")).alias("kind"), "attributes", "text", *(within or {}))


def speeches(found: DataFrame, speaker: str) -> DataFrame:
    """``nodes`` with ``speech``: the number, from 0, of the run of one speaker that a node is in; stage directions (no speaker) break it."""
    w = Window.partitionBy("path").orderBy("idx")
    begins = ~F.col(speaker).eqNullSafe(F.lag(speaker).over(w)) | (F.row_number().over(w) == 1)
    return found.withColumn("_b", begins.cast("int")).withColumn("speech", (F.sum("_b").over(w) - 1).cast("int")).drop("_b")
