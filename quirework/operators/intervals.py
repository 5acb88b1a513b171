"""Half-open intervals ``[start, end)`` within a node. Joins always carry the node as an equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(a: DataFrame, b: DataFrame, node: str, how: str = "inner") -> DataFrame:
    """Rows of ``a`` and ``b`` (each with ``node``, ``start``, ``end``; ``b``'s as ``b_start``, ``b_end``) that overlap; ``how`` may be ``left_anti``."""
    b = b.withColumnsRenamed({node: "_node", "start": "b_start", "end": "b_end"})
    met = (a[node] == b["_node"]) & (a["start"] < b["b_end"]) & (b["b_start"] < a["end"])
    joined = a.join(b, met, how)
    return joined if how.startswith("left_") else joined.drop("_node")


def covers(ranges: Column, length: Column) -> Column:
    """Whether an array of ``struct<start,end>`` covers all of ``0..length``."""
    reach = F.aggregate(F.array_sort(ranges), F.lit(0), lambda r, x: F.when(x["start"] <= r, F.greatest(r, x["end"])).otherwise(r))
    return reach >= length


def add_hide(hides: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """One new interval a group merged with the old ones that overlap or touch it, which it replaces; others stay.

    The merge is one pass: an old interval that touches only the merged result stays as it is.
    """
    new = new.select(*by, F.col("start").alias("n_start"), F.col("end").alias("n_end"))
    both = hides.join(new, by, "left")
    touching = (F.col("start") <= F.col("n_end")) & (F.col("n_start") <= F.col("end"))
    stay = both.where(~F.coalesce(touching, F.lit(False))).select(*by, "start", "end")
    merged = new.join(hides, by, "left").groupBy(*by, "n_start", "n_end").agg(F.min(F.when(touching, F.col("start"))).alias("lo"), F.max(F.when(touching, F.col("end"))).alias("hi"))
    return stay.unionByName(merged.select(*by, F.least("n_start", F.coalesce("lo", "n_start")).alias("start"), F.greatest("n_end", F.coalesce("hi", "n_end")).alias("end")))


def restore(hides: DataFrame, shown: DataFrame, by: list[str]) -> DataFrame:
    """Intervals without the part to be shown again (one interval a group); what lies outside stays."""
    shown = shown.select(*by, F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    both = hides.join(shown, by, "left")
    part = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    start, end = F.col("start"), F.col("end")
    apart = F.col("s_start").isNull() | (F.col("s_end") <= start) | (end <= F.col("s_start"))
    kept = F.when(apart, F.array(part(start, end))).otherwise(F.array(part(start, F.least(end, "s_start")), part(F.greatest(start, "s_end"), end)))
    return both.select(*by, F.inline(F.filter(kept, lambda p: p["start"] < p["end"])))


def segments(spans: DataFrame, by: list[str]) -> DataFrame:
    """The pieces between neighbouring ends of a group's spans that some span covers, with how many cover each.

    Spans are moved once, to their group; its ends are sorted, and how many spans have begun and not ended runs along them.
    """
    turn = F.when(F.col("start") < F.col("end"), 1).otherwise(0)
    ends = spans.where(" and ".join(f"`{c}` is not null" for c in by)).repartition(*by).select(*by, F.inline(F.array(F.struct(F.col("start").alias("start"), turn.alias("_d")), F.struct(F.col("end").alias("start"), (-turn).alias("_d")))))
    w = Window.partitionBy(*by).orderBy("start")
    # ends alike have the same sum, of which the last one's reaches to the next end
    told = ends.where("start is not null").select(*by, "start", F.lead("start").over(w).alias("end"), F.sum("_d").over(w).alias("layers"))
    return told.where("start < end and layers > 0")
