"""How a text's nodes and marks are laid out: rows of a speech, touched lines, merged marks, lines of scenes, terms of entries.

Nodes have ``by`` and ``idx``. Windows and groups lie within one speech, text or scene. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import order


def rows(nodes: DataFrame, by: list[str]) -> DataFrame:
    """``nodes`` (``kind``, ``form``, ``part``) with ``row`` and ``row_kind``: prose lines flow together, and parts of one verse line share a row; a direction stands alone."""
    w = Window.partitionBy(*by).orderBy("idx")
    line = F.col("kind") == "line"
    prose = line & F.coalesce(F.col("form") == "prose", F.lit(False))
    kind = F.when(prose, "prose").when(line, "verse").otherwise("sd")
    told = nodes.withColumn("row_kind", kind)
    goes_on = F.lag("part").over(w).isin("initial", "medial") & F.col("part").isin("medial", "final")
    same = (F.lag("row_kind").over(w) == F.col("row_kind")) & ((F.col("row_kind") == "prose") | ((F.col("row_kind") == "verse") & goes_on))
    return order.islands(told, by, "idx", F.coalesce(same, F.lit(False)), "row")


def touched(nodes: DataFrame, ranges: DataFrame, by: str) -> DataFrame:
    """``id``, ``by``, ``idx``: the lines from one end of a range to the other, whichever comes first; an end that is not there is the text's first node, or the other end."""
    there = nodes.select(by, "idx")
    ends = ranges.select("id", by, "start_idx", "end_idx").join(there.select(by, F.col("idx").alias("start_idx"), F.lit(True).alias("_s")), [by, "start_idx"], "left").join(there.select(by, F.col("idx").alias("end_idx"), F.lit(True).alias("_e")), [by, "end_idx"], "left")
    a = F.when(F.col("_s"), F.col("start_idx")).otherwise(0)
    b = F.when(F.col("_e"), F.col("end_idx")).otherwise(a)
    dealt = ends.select("id", by, F.explode(F.sequence(F.least(a, b), F.greatest(a, b))).alias("idx"))
    return dealt.join(nodes.where("kind = 'line'").select(by, "idx"), [by, "idx"]).select("id", by, "idx")


def merged_marks(marks: DataFrame, by: str, top: str, width: float = 4) -> DataFrame:
    """``by``, ``top``, ``ids``: marks at most ``width`` below a group's first one share its place.

    A group begins where the last one's reach ends, so a mark's group depends on all before it: places are folded
    in order, a text's list at a time.
    """
    listed = marks.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(top).cast("double").alias("top"), "id"))).alias("marks"))
    kind = "array<struct<top:double,ids:array<" + marks.schema["id"].dataType.simpleString() + ">>>"

    def put(groups: Column, mark: Column) -> Column:
        joins = (F.size(groups) > 0) & (mark["top"] - F.try_element_at(groups, F.lit(-1))["top"] < width)
        grown = F.concat(F.slice(groups, 1, F.greatest(F.size(groups) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(groups, F.lit(-1))["top"].alias("top"), F.concat(F.try_element_at(groups, F.lit(-1))["ids"], F.array(mark["id"])).alias("ids"))))
        return F.when(joins, grown).otherwise(F.concat(groups, F.array(F.struct(mark["top"].alias("top"), F.array(mark["id"]).alias("ids")))))

    return listed.select(by, F.inline(F.aggregate("marks", F.array().cast(kind), put)))


def in_order(places: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """``places`` (``by``, ``node``, ``start``) with ``turn``, their order in the text; those in no known node come first."""
    met = places.join(nodes.select(by, "node", F.col("idx").alias("_at")), [by, "node"], "left").withColumn("_at", F.coalesce("_at", F.lit(-1)))
    return met.withColumn("turn", F.row_number().over(Window.partitionBy(by).orderBy("_at", "start", "node"))).drop("_at")


def scene_lines(nodes: DataFrame, by: str) -> DataFrame:
    """``by``, ``scene``, ``place``, ``idx``, ``number``: each scene's lines in order with the number at the end of theirs.

    ``nodes`` have ``act``, ``scene_kind``, ``no``, ``kind``, ``n``. Scenes without a number are known by their kind alone, and of two
    with one key the later in the text counts.
    """
    key = F.when(F.col("scene_kind") == "scene", F.concat(F.coalesce(F.col("act").cast("string"), F.lit("null")), F.lit("."), F.col("no").cast("string"))).otherwise(F.col("scene_kind"))
    w = Window.partitionBy(by).orderBy("idx")
    same = F.struct("act", "scene_kind", "no").eqNullSafe(F.lag(F.struct("act", "scene_kind", "no")).over(w))
    runs = order.islands(nodes.withColumn("scene", key), [by], "idx", same, "_run")
    last = runs.withColumn("_last", F.max("_run").over(Window.partitionBy(by, "scene"))).where("_run = _last and kind = 'line'")
    return last.select(by, "scene", F.row_number().over(Window.partitionBy(by, "scene").orderBy("idx")).alias("place"), "idx", F.nullif(F.regexp_extract(F.coalesce("n", F.lit("")), r"(\d+)$", 1), F.lit("")).cast("int").alias("number"))


def cited_senses(entries: DataFrame, play: str) -> DataFrame:
    """``entry``, ``headword``, ``part_of_speech``, ``sense``, ``label``, ``gloss`` and the citations of one play, a row each, of senses that say what they mean."""
    rows = entries.where(F.coalesce(F.length("gloss"), F.lit(0)) > 0).select("book", "entry", "headword", "part_of_speech", "sense", "label", "gloss", F.posexplode("citations").alias("c", "cite"))
    return rows.where(F.col("cite.play") == play).select("book", "entry", "headword", "part_of_speech", "sense", "label", "gloss", "c", "cite.act", "cite.scene", "cite.part", "cite.line", "cite.quote")
