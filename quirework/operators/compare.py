"""Two versions of a text side by side, matched through the version that both are aligned to.

A version's nodes have ``by`` and ``idx``, places that follow one another without gaps, and for word
differences ``text``. Its alignment has ``by``, ``entry``, ``orig`` (its nodes) and ``modern`` (nodes of the
common version), arrays of places; the common version itself needs none. Null arrays are empty, and of
several entries that hold a node the greatest counts. Every window lies within one text of a version.
Empty tables give empty results.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions import text as tx
from ..functions.kept import kept
from . import order, sequences


def units(nodes: DataFrame, entries: DataFrame | None, by: str) -> DataFrame:
    """``by``, ``idx``, ``unit``, ``modern``: each node with the number of its unit, consecutive nodes of one entry, and what that corresponds to."""
    rows = nodes.select(by, F.col("idx").cast("int").alias("idx"))
    if entries is None:
        return rows.select(by, "idx", F.col("idx").alias("unit"), F.array("idx").alias("modern"))
    of = entries.select(by, "entry", F.explode("orig").alias("idx")).groupBy(by, "idx").agg(F.max("entry").alias("entry"))
    told = rows.join(of, [by, "idx"], "left").join(entries.select(by, "entry", F.coalesce("modern", F.array().cast("array<int>")).alias("modern")).dropDuplicates([by, "entry"]), [by, "entry"], "left")
    same = F.col("entry") == F.lag("entry").over(Window.partitionBy(by).orderBy("idx"))
    return order.islands(told, [by], "idx", F.coalesce(same, F.lit(False)), "unit").select(by, "idx", F.col("unit").cast("int").alias("unit"), F.coalesce("modern", F.array().cast("array<int>")).alias("modern"))


def claims(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """``by``, ``idx``, ``unit``: each node of the right units with the first left unit that shares a counterpart with its own."""
    sides = [u.select(by, name, F.explode(F.array_distinct("modern")).alias("m")) for u, name in ((left, F.col("unit").alias("row")), (right, F.col("idx")))]
    return sides[0].distinct().join(sides[1], [by, "m"]).groupBy(by, "idx").agg(F.min("row").alias("row"))


def rows(left: DataFrame, right: DataFrame, by: str, left_entries: DataFrame | None = None, right_entries: DataFrame | None = None) -> DataFrame:
    """``by``, ``place``, ``left``, ``right`` (arrays of places), ``moved``: every node of both versions once, in the left one's order.

    A right node stands in the row of the first left unit that shares a counterpart with it. Right nodes that no
    row claims follow the row of the claimed node before them, consecutive ones in one row. ``moved`` rows lie
    before the furthest right node so far.
    """
    mine, theirs = kept(units(left, left_entries, by)), kept(units(right, right_entries, by))
    grouped = lambda c: F.array_sort(F.collect_list(c))
    lefts = mine.groupBy(by, F.col("unit").alias("row")).agg(grouped("idx").alias("left"))
    held = theirs.select(by, "idx").join(claims(mine, theirs, by), [by, "idx"], "left")
    known = held.where("row is not null").groupBy(by, "row").agg(grouped("idx").alias("right"))
    after = F.coalesce(F.last("row", ignorenulls=True).over(Window.partitionBy(by).orderBy("idx")), F.lit(-1))
    free = held.withColumn("after", after).where("row is null")
    next_to = F.col("idx") == F.lag("idx").over(Window.partitionBy(by, "after").orderBy("idx")) + 1
    runs = order.islands(free, [by, "after"], "idx", F.coalesce(next_to, F.lit(False)), "run").groupBy(by, F.col("after").alias("row"), "run").agg(grouped("idx").alias("right"))
    none = F.array().cast("array<int>")
    laid = lefts.join(known, [by, "row"], "left").select(by, "row", F.lit(0).alias("run"), "left", "right").unionByName(runs.select(by, "row", "run", none.alias("left"), "right"))
    w = Window.partitionBy(by).orderBy("row", "run")
    furthest = F.max(F.array_max("right")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return laid.select(by, F.row_number().over(w).alias("place"), F.coalesce("left", none).alias("left"), F.coalesce("right", none).alias("right"), F.coalesce(F.array_min("right") < furthest, F.lit(False)).alias("moved"))


def _runs(nodes: DataFrame, by: str) -> DataFrame:
    """``by``, ``idx``, ``runs`` (a node's words and what is between them) and ``starts``, their places in it."""
    arrays.bounded(nodes.sparkSession)
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\s—–-]+|[\s—–-]+"), F.lit(0))
    starts = F.arrow_udf(arrays.starts, "array<int>")
    told = nodes.select(by, "idx", runs.alias("runs")).withColumn("sizes", F.transform("runs", F.length))
    return told.withColumn("starts", starts("sizes")).drop("sizes")


def word_spans(nodes: DataFrame, by: str) -> DataFrame:
    """``by``, ``idx``, ``n``, ``start``, ``end``, ``word``: a node's words between white space, hyphens and dashes, with their place in it."""
    dealt = _runs(nodes, by).select(by, "idx", F.posexplode(F.arrays_zip(F.col("starts").alias("start"), F.col("runs").alias("word"))).alias("n", "w")).select(by, "idx", "n", "w.start", (F.col("w.start") + F.length("w.word")).alias("end"), "w.word")
    return dealt.where(F.col("word").rlike(r"^[^\s—–-]"))


#: What ``_runs`` takes for a word.
_WORD = re.compile(r"[^ \t\n\x0b\f\r—–-]+")


def _key(word: str) -> str:
    """What a word is compared by: its spelling-insensitive key; ``&`` is ``and``."""
    return "and" if word == "&" else tx.key(word)


def differences(compared: DataFrame, left: DataFrame, right: DataFrame, by: str, exact: bool = False) -> DataFrame:
    """``by``, ``place``, ``side``, ``idx``, ``start``, ``end``: the words of each row of ``compared`` that its other side lacks, by node.

    Words that both sides have are those of a longest common subsequence; where two ways are as long, right words
    are passed over first. A text's nodes and rows are a row, and its words are told from its nodes where they are compared.
    """
    arrays.bounded(compared.sparkSession)
    names = ("idx", "text", "key")
    # keys of letters alone are told by a dictionary of words, those of signs at words' ends by their classes
    said = tx.spaced(F.col("text"), lambda words: F.regexp_replace(F.regexp_replace(words, r"(?<![^ ])&(?![^ ])", "and"), r"(?<![^ ])[^\p{L}\p{N} ]+|[^\p{L}\p{N} ]+(?![^ ])", "")) if exact else F.lit(None).cast("string")
    listed = lambda rows, own, name: rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*own))).alias(name)).select(by, *[F.col(f"{name}.{c}").alias(f"{name}_{c}") for c in own])
    sides = [listed(nodes.select(by, "idx", F.coalesce("text", F.lit("")).alias("text"), said.alias("key")), names, side) for nodes, side in ((left, "left"), (right, "right"))]
    both = listed(compared, ("place", "left", "right"), "rows").join(sides[0], by, "left").join(sides[1], by, "left")

    def words(columns: list[pa.Scalar]) -> dict[int, tuple[list, list, list]]:
        """For each node its words' starts, ends and keys."""
        told = {}
        for idx, text, keys in zip(*[c.as_py() or () for c in columns], strict=True):
            spots = [m.span() for m in _WORD.finditer(text)]
            named = keys.split(" ") if keys is not None else [_key(text[a:b]) for a, b in spots]
            kept = [(a, b, k) for (a, b), k in zip(spots, named, strict=False) if k]
            told[idx] = tuple(map(list, zip(*kept, strict=True))) if kept else ([], [], [])
        return told

    def run(*columns: pa.Array) -> pa.Array:
        counts, out = [0], [[] for _ in range(5)]
        for places, lefts, rights, *texts in zip(*columns, strict=True):
            known = (words(texts[:3]), words(texts[3:]))
            for place, *nodes in zip(places.as_py(), lefts.as_py(), rights.as_py(), strict=True):
                held = [[n for n in own or () if n in of] for own, of in zip(nodes, known, strict=True)]
                keys = [[k for n in own for k in of[n][2]] for own, of in zip(held, known, strict=True)]
                pairs = sequences.common(keys[1], keys[0]) if keys[0] and keys[1] else []
                for side, own, of, met in zip((0, 1), held, known, ({i for _, i in pairs}, {j for j, _ in pairs}), strict=True):
                    at = 0
                    for n in own:
                        starts, ends, _ = of[n]
                        which = [k for k in range(len(starts)) if at + k not in met] if met else range(len(starts))
                        at += len(starts)
                        for column, values in zip(out, ([place] * len(which), [side] * len(which), [n] * len(which), [starts[k] for k in which], [ends[k] for k in which]), strict=True):
                            column += values
            counts.append(len(out[0]))
        kinds = [columns[0].type.value_type, *[pa.int32()] * 4]
        return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["place", "side", "idx", "start", "end"]))

    kind = compared.schema["place"].dataType.simpleString()
    lacking = F.arrow_udf(run, f"array<struct<place:{kind},side:int,idx:int,start:int,end:int>>")
    told = both.select(by, F.inline(lacking(*[F.col(f"rows_{c}") for c in ("place", "left", "right")], *[F.col(f"{s}_{c}") for s in ("left", "right") for c in names])))
    return told.select(by, "place", F.when(F.col("side") == 0, "left").otherwise("right").alias("side"), "idx", "start", "end")


def by_node(ranges: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """``by``, ``idx``, ``start``, ``end``: the part of each range of a joined text that lies in each node.

    ``ranges`` has ``by``, ``start``, ``end`` in the nodes' texts joined by line ends; ``nodes`` is ordered by ``idx``
    and has ``text``. Ranges are dealt to the nodes they touch by stretches of 256 characters.
    """
    placed = order.running_offset(nodes.select(by, "idx", F.length(F.coalesce("text", F.lit(""))).alias("size")), [by], "idx", F.col("size") + 1, "begin")
    stretch = lambda c: F.floor(c / 256)
    held = placed.where("size > 0").withColumn("stretch", F.explode(F.sequence(stretch(F.col("begin")), stretch(F.col("begin") + F.col("size") - 1))))
    asked = ranges.where("start < end").select(by, F.col("start").alias("a"), F.col("end").alias("b"), F.explode(F.sequence(stretch(F.greatest("start", F.lit(0))), stretch(F.col("end") - 1))).alias("stretch"))
    a, b = F.greatest(F.col("a") - F.col("begin"), F.lit(0)), F.least(F.col("b") - F.col("begin"), F.col("size"))
    cut = held.join(asked, [by, "stretch"]).where(b > a)
    # a range and a node that share several stretches meet in the first one
    first = F.col("stretch") == F.greatest(stretch(F.col("begin")), stretch(F.greatest("a", F.lit(0))))
    return cut.where(first).select(by, "idx", a.cast("int").alias("start"), b.cast("int").alias("end"))
