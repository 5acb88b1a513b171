"""Edit overlays: what a list of hides, replacements and insertions leaves of a text. The text itself never changes.

Operations have ``id``, ``type`` (``hide``, ``replace`` or ``insert``), the text's key ``by``, the span of a hide or a
replacement (as in ``anchors``), and for an insertion ``after``, the place of the node it follows, and ``n``, its turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors, intervals


def hidden_nodes(ops: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """``by``, ``idx`` of nodes whose whole text is hidden and in which no replacement begins; a hidden empty node is not covered by any span and stays."""
    spans = ops.where("type <> 'insert'")
    parts = anchors.pieces(spans, nodes, by).groupBy(by, "idx", "text").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    begun = spans.where("type = 'replace'").select(by, F.col("start_idx").alias("idx")).distinct()
    return parts.where(intervals.covers(F.col("ranges"), F.length("text"))).select(by, "idx").join(begun, [by, "idx"], "left_anti")


def hidden_groups(hidden: DataFrame, nodes: DataFrame, by: str, group: str) -> DataFrame:
    """``by``, ``group`` (a scene) of which every node is hidden."""
    mark = nodes.select(by, group, "idx").join(hidden.select(by, "idx", F.lit(True).alias("_h")), [by, "idx"], "left")
    return mark.groupBy(by, group).agg(F.every(F.coalesce("_h", F.lit(False))).alias("_all")).where("_all").select(by, group)


def displayed(ops: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """``by``, ``idx``, ``turn``, ``text``, ``op``: the nodes left, with the nodes added behind the node that each follows, hidden or not.

    ``turn`` is 0 for a node of the text and counts its insertions from 1. Order is by ``idx``, ``turn``.
    Insertions after a node that is not there do nothing.
    """
    left = nodes.join(hidden_nodes(ops, nodes, by), [by, "idx"], "left_anti").select(by, "idx", F.lit(0).alias("turn"), "text", F.lit(None).cast("string").alias("op"))
    listed = F.array_sort(F.collect_list(F.struct("n", F.col("id").cast("string").alias("id"), "insert_text")))
    added = ops.where("type = 'insert'").withColumn("idx", F.col("after")).join(nodes.select(by, "idx"), [by, "idx"], "left_semi")
    added = added.groupBy(by, "idx").agg(listed.alias("l")).select(by, "idx", F.posexplode("l").alias("p", "x")).select(by, "idx", (F.col("p") + 1).alias("turn"), F.col("x.insert_text").alias("text"), F.col("x.id").alias("op"))
    return left.unionByName(added)


def landing(shown: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """``by``, ``idx``, ``lands``: for each node of the text its own place if displayed, else that of the next displayed node, behind the last one that one; null if none is left."""
    from .order import fill_backward

    own = shown.where("turn = 0").select(by, "idx", F.col("idx").alias("lands"))
    return fill_backward(nodes.select(by, "idx").join(own, [by, "idx"], "left"), [by], "idx", "lands")


def replaceable(wanted: DataFrame, ops: DataFrame, by: str) -> DataFrame:
    """``wanted`` replacements that may be made: those that hold no character of a hide or replacement; spans that only touch one may.

    Spans that overlap share a node, so both sides are dealt to their nodes and meet by an equality.
    """
    dealt = lambda df, *keep: df.where("start_idx <= end_idx").select(by, *keep, F.explode(F.sequence("start_idx", "end_idx")).alias("idx"))
    at = lambda a, b: F.struct(F.col(a).alias("i"), F.col(b).alias("o"))
    ends = lambda p: [at("start_idx", "start_off").alias(p + "a"), at("end_idx", "end_off").alias(p + "b")]
    met = dealt(wanted, "id", *ends("w")).join(dealt(ops.where("type <> 'insert'"), *ends("o")), [by, "idx"])
    return wanted.join(met.where("oa < wb and wa < ob").select("id").distinct(), "id", "left_anti")


def reworded(ops: DataFrame, edits: DataFrame) -> DataFrame:
    """``ops`` with the texts of ``edits`` (``id``, ``text``) in the replacements and insertions of those ids; hides have no text."""
    met = ops.join(edits.select("id", F.struct("text").alias("_e")), "id", "left")
    return met.withColumn("insert_text", F.when(F.col("_e").isNotNull() & (F.col("type") != "hide"), F.col("_e.text")).otherwise(F.col("insert_text"))).select(*ops.columns)


def decorations(terms: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """``by``, ``idx``, ``start``, ``end``, ``terms``: the spans to mark in each node, with the ids of the terms on exactly that anchor; equal anchors are one."""
    keyed = terms.groupBy(by, *anchors.PLACE).agg(F.array_sort(F.collect_set("id")).alias("terms")).withColumn("id", anchors.span_key())
    parts = anchors.pieces(keyed, nodes, by)
    return parts.join(keyed.select(by, "id", "terms"), [by, "id"]).select(by, "idx", "start", "end", "terms")
