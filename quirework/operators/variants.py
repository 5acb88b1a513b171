"""Variants between the versions of a text: seeded from passages that an edition marks, and where they show in a version.

Nodes have ``by``, ``version``, ``idx`` (places without gaps) and ``text``; the edition's own also ``number`` where they are
numbered lines. Alignments have ``by``, ``version``, ``entry``, ``orig`` and ``modern`` (arrays of places). Readings that a
version lacks have no span and no text. Null texts are empty; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.kept import kept
from . import anchors, order

#: Nodes between two aligned nodes that still count as one reading, less one.
GAP = 3


def lacks(description: Column, version: Column) -> Column:
    """Whether a description says that a printing lacks the passage: ``not found in the second quarto``; a quarto without number is any."""
    said = F.regexp_extract(description, r"(?i)not found in the (?:(first|second) )?(quarto|folio)", 0)
    folio, first, second = (F.lower(said).contains(w) for w in ("folio", "first", "second"))
    prefix = F.when(folio, "f1-").when(second, "q2-").when(first, "q1-").otherwise("q")
    return F.coalesce((said != "") & version.startswith(prefix), F.lit(False))


def passages(tokens: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """``by``, ``passage``, ``description``, the span from the first to the last of its tokens that the text has, ``text`` and ``number``.

    ``tokens`` have ``by``, ``passage``, ``description``, ``turn``, ``idx``, ``start``, ``end``; without ``idx`` they are not in the text.
    Passages without a token in it, or without text, are left out. ``number`` is that of its first numbered line.
    """
    there = tokens.where("idx is not null").groupBy(by, "passage").agg(F.first("description").alias("description"), F.min_by(F.struct("idx", "start"), "turn").alias("a"), F.max_by(F.struct("idx", "end"), "turn").alias("z"))
    spans = there.select(by, "passage", "description", F.col("a.idx").alias("start_idx"), F.col("a.start").alias("start_off"), F.col("z.idx").alias("end_idx"), F.col("z.end").alias("end_off")).withColumn("id", F.struct(by, "passage"))
    said = anchors.quotes(spans, nodes, by, 0).select("id", F.col("exact").alias("text")).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    numbered = spans.where("start_idx <= end_idx").select("id", by, F.explode(F.sequence("start_idx", "end_idx")).alias("idx")).join(nodes.where("number is not null").select(by, "idx", "number"), [by, "idx"])
    number = numbered.groupBy("id").agg(F.min_by("number", "idx").alias("number"))
    return spans.join(said, "id").join(number, "id", "left").drop("id")


def title(description: Column, text: Column, number: Column, most: int = 60) -> Column:
    """``Description: “text” (number)``, a long text cut short."""
    head = F.concat(F.upper(F.substring(description, 1, 1)), F.substring(description, 2, 1_000_000))
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    short = F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)
    return F.concat(head, F.lit(": “"), short, F.lit("”"), F.coalesce(F.concat(F.lit(" ("), number, F.lit(")")), F.lit("")))


def seeded(found: DataFrame, originals: DataFrame, entries: DataFrame, by: str) -> DataFrame:
    """``by``, ``passage``, ``version``, a span and ``text``: what each original version reads where ``found`` of ``passages`` stands in the edition.

    That is the nodes aligned with the passage's, from the first on while no more than ``GAP - 1`` others stand between two;
    a reordered version may have more of them far off. A printing that the edition says lacks the passage has no reading,
    whatever is aligned.
    """
    asked = found.join(originals.select(by, "version").distinct(), by).select(by, "passage", "version", lacks(F.col("description"), F.col("version")).alias("lacks"), "start_idx", "end_idx")
    asked = kept(asked)
    held = asked.where("not lacks").select(by, "passage", "version", F.explode(F.sequence("start_idx", "end_idx")).alias("m"))
    edges = entries.select(by, "version", F.explode("modern").alias("m"), "orig").select(by, "version", "m", F.explode("orig").alias("idx"))
    met = held.join(edges, [by, "version", "m"]).select(by, "passage", "version", "idx").distinct()
    w = Window.partitionBy(by, "passage", "version").orderBy("idx")
    runs = order.islands(met, [by, "passage", "version"], "idx", F.coalesce(F.col("idx") - F.lag("idx").over(w) <= GAP, F.lit(False)), "run")
    reach = runs.where("run = 1").groupBy(by, "passage", "version").agg(F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"))
    text = F.coalesce("text", F.lit(""))
    lines = reach.select(by, "passage", "version", F.explode(F.sequence("start_idx", "end_idx")).alias("idx")).join(originals.select(by, "version", "idx", text.alias("text")), [by, "version", "idx"])
    listed = F.array_sort(F.collect_list(F.struct("idx", "text")))
    read = lines.groupBy(by, "passage", "version").agg(F.array_join(F.transform(listed, lambda r: r["text"]), "\n").alias("text"), F.min("idx").alias("start_idx"), F.max(F.struct("idx", F.length("text").alias("size"))).alias("z"))
    told = asked.select(by, "passage", "version").join(read, [by, "passage", "version"], "left")
    return told.select(by, "passage", "version", "start_idx", F.when(F.col("start_idx").isNotNull(), 0).alias("start_off"), F.col("z.idx").alias("end_idx"), F.col("z.size").alias("end_off"), F.coalesce("text", F.lit("")).alias("text"))


def places(starts: DataFrame, entries: DataFrame, by: str) -> DataFrame:
    """``starts`` (``by``, ``modern``) with ``within``, the node in whose line a missing passage belongs, or ``after``, the node that it follows.

    ``entries`` are one version's, in the order of ``entry``. A passage before all aligned text, or on no entry, has no place.
    """
    earlier = Window.partitionBy(by).orderBy("entry").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("orig") > 0, F.element_at("orig", -1))
    told = entries.select(by, "entry", "modern", F.when(F.size("orig") > 0, F.col("orig")[0]).alias("within"), F.last(last, ignorenulls=True).over(earlier).alias("before"))
    first = told.select(by, "entry", "within", "before", F.explode("modern").alias("modern")).groupBy(by, "modern").agg(F.min(F.struct("entry", "within", "before")).alias("e"))
    return starts.join(first, [by, "modern"], "left").withColumn("within", F.col("e.within")).withColumn("after", F.when(F.col("within").isNull(), F.col("e.before"))).drop("e")


def marks(readings: DataFrame, versions: DataFrame, nodes: DataFrame, entries: DataFrame, by: str, modern: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Where variants show in each version that is no edition of its own: spans, starts and absent marks.

    ``readings`` have ``by``, ``variant``, ``turn`` (the variant's place in the list), ``version``, ``rank`` (the reading's place), a
    span and ``text``; ``versions`` have ``by``, ``version``, ``original``, ``name``. Spans: ``by``, ``version``, ``idx``, ``start``, ``end``,
    ``variant``. Starts: ``by``, ``version``, ``idx``, ``variants`` in order, with those of which words are missing from the line.
    Absent: ``by``, ``version``, ``after``, ``label`` (``Folio and Quarto have 2 lines here``), ``variants``, one row a label; only of passages that
    another original has.
    """
    there = readings.where("start_idx is not null")
    known = there.join(nodes.select(by, "version", F.col("idx").alias("start_idx")), [by, "version", "start_idx"], "left_semi")
    key = F.struct("version", "variant")
    at = known.select(F.col(by), key.alias("id"), *anchors.PLACE).withColumn("text_key", F.struct(by, "id.version"))
    spans = anchors.pieces(at.withColumnRenamed("text_key", "_k"), nodes.select(F.struct(by, "version").alias("_k"), "idx", "text"), "_k")
    spans = spans.select(F.col(f"_k.{by}").alias(by), F.col("_k.version").alias("version"), "idx", "start", "end", F.col("id.variant").alias("variant"))
    gone = readings.where("start_idx is null").select(by, "variant", "turn", "version")
    named = there.join(versions.where("original"), [by, "version"]).groupBy(by, "variant").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "text"))).alias("having"))
    first = there.where(F.col("version") == modern).select(by, "variant", F.col("start_idx").alias("modern"))
    lost = gone.join(named, [by, "variant"]).join(first, [by, "variant"])
    placed = places(lost.withColumn("_k", F.struct(by, "version")), entries.withColumn("_k", F.struct(by, "version")).select("_k", "entry", "orig", "modern"), "_k")
    names = F.transform("having", lambda h: h["name"])
    lines = F.size(F.split(F.col("having")[0]["text"], "\n"))
    label = F.concat(tx.name_list(names), F.when(F.size(names) == 1, " has ").otherwise(" have "), lines.cast("string"), F.when(lines == 1, " line here").otherwise(" lines here"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "variant"))), lambda v: v["variant"])
    absent = placed.where("after is not null").withColumn("label", label).groupBy(by, "version", "after", "label").agg(ordered.alias("variants"))
    begun = known.select(by, "version", F.col("start_idx").alias("idx"), "turn", "variant").unionByName(placed.where("within is not null").select(by, "version", F.col("within").alias("idx"), "turn", "variant"))
    return spans, begun.groupBy(by, "version", "idx").agg(ordered.alias("variants")), absent
