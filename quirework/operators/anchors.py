"""Stand-off anchors: spans over the ordered nodes of a text, with the quotation to find them again by.

An anchor has ``id``, the text's key ``by``, ``start_idx``, ``start_off``, ``end_idx`` and ``end_off``: from the
offset in the first node up to, not with, the offset in the last. Nodes have ``by``, ``idx`` and ``text``, which
holds no line end; places follow one another without gaps; null reads as empty. Spans are dealt to their nodes by an equality of key and place, so a text
with many spans or nodes is no hot group of pairs. Anchors on nodes that are not there have no pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters, digits and what joins words; and what is cut from a span's ends.
WORD, TRIM = r"[\p{L}\p{N}'’-]", r"[\s\p{P}]"
PLACE = ("start_idx", "start_off", "end_idx", "end_off")


def span_key(prefix: str = "") -> Column:
    """A key that equal spans share."""
    a, b, c, d = (F.col(prefix + p).cast("string") for p in PLACE)
    return F.concat(a, F.lit(":"), b, F.lit("-"), c, F.lit(":"), d)


def holds(idx: Column, off: Column) -> Column:
    """Whether a span holds the character at a position."""
    at = F.struct(idx.alias("i"), off.alias("o"))
    return (F.struct(F.col("start_idx").alias("i"), F.col("start_off").alias("o")) <= at) & (at < F.struct(F.col("end_idx").alias("i"), F.col("end_off").alias("o")))


def pieces(anchors: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """``id``, ``by``, ``idx``, ``start``, ``end``, ``text``: the part of each node that a span covers, empty parts left out."""
    dealt = anchors.where("start_idx <= end_idx").select("id", by, *PLACE, F.explode(F.sequence("start_idx", "end_idx")).alias("idx"))
    met = dealt.join(nodes.select(by, "idx", F.coalesce("text", F.lit("")).alias("text")), [by, "idx"])
    start = F.when(F.col("idx") == F.col("start_idx"), F.col("start_off")).otherwise(0)
    end = F.when(F.col("idx") == F.col("end_idx"), F.least("end_off", F.length("text"))).otherwise(F.length("text"))
    return met.select("id", by, "idx", start.alias("start"), end.alias("end"), "text").where("start < end")


def quotes(anchors: DataFrame, nodes: DataFrame, by: str, context: int = 32) -> DataFrame:
    """``id`` with ``exact`` (the nodes' parts, joined by line ends), and ``prefix`` and ``suffix``, up to ``context`` characters beside it in the outer nodes.

    Both outer nodes must be there. ``exact`` may be empty.
    """
    dealt = anchors.where("start_idx <= end_idx").select("id", by, *PLACE, F.explode(F.sequence("start_idx", "end_idx")).alias("idx"))
    met = dealt.join(nodes.select(by, "idx", F.coalesce("text", F.lit("")).alias("text")), [by, "idx"])
    first, last = F.col("idx") == F.col("start_idx"), F.col("idx") == F.col("end_idx")
    a = F.when(first, F.col("start_off")).otherwise(0)
    b = F.when(last, F.col("end_off")).otherwise(F.length("text"))
    part = F.substring(F.col("text"), a + 1, F.greatest(b - a, F.lit(0)))
    lead = F.greatest(F.col("start_off") - context, F.lit(0))
    told = met.groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", part.alias("part")))), lambda p: p["part"]), "\n").alias("exact"),
        F.max(F.when(first, F.substring(F.col("text"), lead + 1, F.col("start_off") - lead))).alias("prefix"),
        F.max(F.when(last, F.substring(F.col("text"), F.col("end_off") + 1, F.lit(context)))).alias("suffix"),
    )
    return told.where("prefix is not null and suffix is not null")


def snapped(anchors: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """``id`` and its span, widened to whole words and then without white space and punctuation at both ends; spans of which nothing is left go."""
    text = lambda name: nodes.select(by, F.col("idx").alias(f"{name}_idx"), F.coalesce("text", F.lit("")).alias(f"_{name}"))
    both = anchors.join(text("start"), [by, "start_idx"]).join(text("end"), [by, "end_idx"])
    at = lambda t, off: F.substring(F.col(t), off, F.lit(1)).rlike(WORD)
    before = F.length(F.regexp_extract(F.substring(F.col("_start"), F.lit(1), F.col("start_off")), f"({WORD}*)$", 1))
    after = F.length(F.regexp_extract(F.substring(F.col("_end"), F.col("end_off") + 1, F.length("_end")), f"^({WORD}*)", 1))
    wide = both.select(
        "id", by, "start_idx", "end_idx",
        F.when((F.col("start_off") > 0) & at("_start", F.col("start_off") + 1), F.col("start_off") - before).otherwise(F.col("start_off")).alias("start_off"),
        F.when((F.col("end_off") > 0) & at("_end", F.col("end_off")), F.col("end_off") + after).otherwise(F.col("end_off")).alias("end_off"),
    )
    part = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    left = F.length(F.regexp_extract(part, f"^({TRIM}*)", 1))
    right = F.length(F.regexp_extract(part, f"({TRIM}*)$", 1))
    held = pieces(wide, nodes, by).where(part.rlike(f"[^{TRIM[1:]}")).select("id", "idx", (F.col("start") + left).alias("a"), (F.col("end") - right).alias("b"))
    ends = held.groupBy("id").agg(F.min(F.struct("idx", "a")).alias("s"), F.max(F.struct("idx", "b")).alias("e"))
    return ends.select("id", F.col("s.idx").alias("start_idx"), F.col("s.a").alias("start_off"), F.col("e.idx").alias("end_idx"), F.col("e.b").alias("end_off"))
