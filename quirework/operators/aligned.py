"""Whole versions aligned scene by scene, and what an alignment tells of a version: its line numbers and speakers.

Scenes have ``by``, ``turn``, ``act``, ``kind``, ``no``; nodes ``by``, ``turn`` (their scene), ``idx`` (reading order in the version),
``kind`` and ``keys`` (word keys). A scene's pair is a group of rows; nothing larger is in one task. Empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kept import kept
from . import divisions, order, sequences


def counterparts(orig: DataFrame, modern: DataFrame, by: str) -> DataFrame:
    """``by``, ``turn``, ``modern``: the modern scene of the same key, or for a prologue or epilogue the only one of its kind; a scene without one stops the job."""
    key = divisions.scene_key(F.col("act"), F.col("kind"), F.col("no")).alias("key")
    same = modern.select(by, key, F.col("turn").alias("same"))
    only = modern.where("kind <> 'scene'").groupBy(by, "kind").agg(F.min("turn").alias("only"), F.count("*").alias("m")).where("m = 1").drop("m")
    met = orig.withColumn("key", key).join(same, [by, "key"], "left").join(only, [by, "kind"], "left").withColumn("modern", F.coalesce("same", "only"))
    lost = F.raise_error(F.concat(F.col(by).cast("string"), F.lit(": scene "), F.col("key"), F.lit(" has no counterpart"))).cast("int")
    return met.select(by, "turn", F.when(F.col("modern").isNull(), lost).otherwise(F.col("modern")).alias("modern"))


def versions(orig: DataFrame, modern: DataFrame, orig_scenes: DataFrame, modern_scenes: DataFrame, by: str) -> DataFrame:
    """``by``, ``entry`` (from 0), ``orig``, ``modern`` (arrays of places), ``relation``: two versions aligned, in the original's reading order.

    All pieces of one modern scene are aligned with it together, and what is modern alone goes with the piece before it.
    Modern scenes that the original lacks stand before its first scene whose counterpart comes later, node by node.
    """
    pairs = kept(counterparts(orig_scenes, modern_scenes, by))
    nodes = lambda rows, side: rows.select(by, "scene", F.lit(side).alias("side"), F.col("idx").cast("int").alias("n"), "kind", F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))
    # a text's pairs are one row, so that nodes that lie together by text are not moved for them
    met = pairs.groupBy(by).agg(F.collect_list(F.struct("turn", "modern")).alias("_met"))
    to = F.transform(F.filter("_met", lambda p: p["turn"] == F.col("turn")), lambda p: p["modern"])
    pieces = orig.join(met, by).select(*orig.columns, F.explode(to).alias("scene"))
    theirs = modern.withColumnRenamed("turn", "scene").join(met, by, "left").withColumn("_held", F.coalesce(F.exists("_met", lambda p: p["modern"] == F.col("scene")), F.lit(False))).drop("_met")
    held = theirs.where("_held")
    found = kept(sequences.align_blocks(nodes(pieces, "orig").unionByName(nodes(held, "modern")), [by, "scene"]))
    # an entry belongs to the piece of its first node, or of the entry before it
    first = pairs.groupBy(by, F.col("modern").alias("scene")).agg(F.min("turn").alias("first"))
    of = pieces.select(by, "scene", F.col("idx").cast("int").alias("n"), "turn")
    placed = found.withColumn("n", F.when(F.size("orig") > 0, F.col("orig")[0])).join(of, [by, "scene", "n"], "left").drop("n")
    placed = order.fill_forward(placed, [by, "scene"], "entry", "turn").join(first, [by, "scene"]).withColumn("turn", F.coalesce("turn", "first"))
    # modern scenes without counterpart wait for the first original scene that is later than they are
    alone = theirs.where("not _held").select(by, "scene", F.col("idx").cast("int").alias("n"))
    reach = pairs.groupBy(by, F.col("modern")).agg(F.min("turn").alias("turn"))
    later = alone.select(by, "scene").distinct().join(reach, by).where("modern > scene").groupBy(by, "scene").agg(F.min("turn").alias("turn"))
    waiting = alone.join(later, [by, "scene"], "left")
    none = F.array().cast("array<int>")
    last = F.lit(2_147_483_647)
    rows = placed.select(by, F.struct("turn", F.lit(1).alias("late"), F.lit(0).alias("scene"), F.col("entry").alias("at")).alias("place"), "orig", "modern", "relation").unionByName(
        waiting.select(by, F.struct(F.coalesce("turn", last).alias("turn"), F.lit(0).alias("late"), F.col("scene").alias("scene"), F.col("n").alias("at")).alias("place"), none.alias("orig"), F.array("n").alias("modern"), F.lit("modern-only").alias("relation"))
    )
    return rows.select(by, (F.row_number().over(Window.partitionBy(by).orderBy("place")) - 1).alias("entry"), "orig", "modern", "relation")


def numbers(orig: DataFrame, modern: DataFrame, entries: DataFrame, by: str) -> DataFrame:
    """``by``, ``idx``, ``number``: the modern numbers that an alignment gives an original's lines.

    Of an entry with as many lines as numbers each line gets one, else its first line the first; a number is given once, to
    the first line in the order of entries. ``modern`` has ``number``, null where a node has none.
    """
    numbered = lambda rows, side, keep: entries.select(by, "entry", F.posexplode(side).alias("i", "idx")).join(rows.where(keep), [by, "idx"])
    listed = lambda rows, side, value, keep, name: numbered(rows, side, keep).groupBy(by, "entry").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.col(value).alias("v")))), lambda x: x["v"]).alias(name))
    lines = listed(orig.select(by, "idx", "kind"), "orig", "idx", "kind = 'line'", "lines")
    given = listed(modern.select(by, "idx", "kind", "number"), "modern", "number", "kind = 'line' and number is not null and number <> ''", "numbers")
    met = lines.join(given, [by, "entry"])
    pairs = F.when(F.size("lines") == F.size("numbers"), F.arrays_zip("lines", "numbers")).otherwise(F.arrays_zip(F.slice("lines", 1, 1).alias("lines"), F.slice("numbers", 1, 1).alias("numbers")))
    told = met.select(by, "entry", F.posexplode(pairs).alias("i", "p"))
    first = told.groupBy(by, F.col("p.numbers").alias("number")).agg(F.min(F.struct("entry", "i", F.col("p.lines").alias("idx"))).alias("f"))
    return first.select(by, F.col("f.idx").alias("idx"), "number")


def speakers(speeches: DataFrame, voices: DataFrame, entries: DataFrame, by: str, curated: DataFrame | None = None) -> DataFrame:
    """``by``, ``speech``, ``speakers``: who speaks each of an original's speeches.

    ``speeches`` have ``by``, ``speech``, ``label`` and ``idx``, a row a node; ``voices`` are the modern nodes' ``by``, ``idx``, ``speakers``. A
    printed label stands for those with whom most of its nodes are aligned in the whole version, ties by name, so that
    speeches that editors gave to others stay as printed. A speech without label asks for itself; ``curated`` (``by``,
    ``label``, ``speakers``) outranks both, and one aligned with none has none.
    """
    key = F.regexp_replace(F.lower(F.coalesce("label", F.lit(""))), "[^a-z]", "")
    rows = kept(speeches.withColumn("key", key).withColumn("asks", F.when(F.col("key") == "", F.concat(F.lit("#"), F.col("speech").cast("string"))).otherwise(F.col("key"))))
    of = entries.select(by, "entry", "modern", F.explode("orig").alias("idx")).groupBy(by, "idx").agg(F.max_by("modern", "entry").alias("modern"))
    said = rows.join(of, [by, "idx"]).select(by, "asks", F.explode("modern").alias("idx")).join(voices.where(F.size("speakers") > 0).select(by, "idx", F.array_join("speakers", " ").alias("who")), [by, "idx"])
    won = order.majority(said, [by, "asks"], "who").select(by, "asks", F.split("who", " ").alias("won"))
    told = rows.groupBy(by, "speech").agg(F.first("label").alias("label"), F.first("asks").alias("asks")).join(won, [by, "asks"], "left")
    if curated is not None:
        told = told.join(curated.select(by, "label", F.col("speakers").alias("set")), [by, "label"], "left").withColumn("won", F.coalesce("set", "won"))
    return told.select(by, "speech", F.coalesce("won", F.array().cast("array<string>")).alias("speakers"))


def cast(characters: DataFrame, spoken: DataFrame, by: str) -> DataFrame:
    """Those of the modern version's ``characters`` (``by``, ``id``, ...) who speak in ``speakers`` of a version."""
    return characters.join(spoken.select(by, F.explode("speakers").alias("id")).distinct(), [by, "id"], "left_semi")
