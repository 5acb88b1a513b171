"""Collections of notes: merged imports, edits and deletions, free names, import plans, exports, notes at a place.

Notes have an id, ``own`` (made here, not imported) and ``modified``. Every operator is a join or an aggregate on a
key; ids are not null and unique in a table unless a docstring says otherwise. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import anchors, merge


def merged(local: DataFrame, incoming: DataFrame, deleted: DataFrame, restored: DataFrame, content: list[str], id_col: str = "id", rank: str = "n") -> DataFrame:
    """The collection after an import: ``id_col``, ``content``, ``modified``, ``removed_from_source``.

    Outcomes are those of ``merge.import_merge``. Items changed here keep their content and are marked when the file
    lacks them; deleted items that are not restored stay as they are; of repeated incoming ids the first counts.
    """
    outcome = merge.import_merge(local, incoming, deleted, restored, id_col, rank).where("outcome <> 'removed'")
    first = incoming.groupBy(id_col).agg(F.min(F.struct(rank, *content)).alias("_new"))
    mine = local.select(id_col, F.struct(*content).alias("_old"), F.coalesce("modified", F.lit(False)).alias("_modified"))
    both = outcome.join(first, id_col, "left").join(mine, id_col, "left")
    stays = F.col("outcome").isin("keptModified", "previouslyDeleted")
    kept = both.where(~stays | F.col("_old").isNotNull())
    value = lambda c: F.when(stays, F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}")).alias(c)
    return kept.select(id_col, *[value(c) for c in content], (stays & F.col("_modified")).alias("modified"), (stays & F.col("_modified") & F.col("_new").isNull()).alias("removed_from_source"))


def saved(notes: DataFrame, edits: DataFrame, content: list[str], id_col: str = "id", repair: bool = False) -> DataFrame:
    """``notes`` with ``content`` taken from ``edits`` of the same id; imported notes become ``modified``, unless the edit is a ``repair`` of where a note is attached."""
    new = edits.select(id_col, F.struct(*content).alias("_e"))
    met = notes.join(new, id_col, "left")
    hit = F.col("_e").isNotNull()
    put = {c: F.when(hit, F.col(f"_e.{c}")).otherwise(F.col(c)) for c in content}
    if not repair:
        put["modified"] = F.when(hit & ~F.col("own"), True).otherwise(F.col("modified"))
    return met.withColumns(put).select(*notes.columns)


def snapshot(notes: DataFrame, touched: DataFrame, id_col: str = "id") -> DataFrame:
    """Notes as they are now, so that an edit session can be undone: ``id_col`` and ``record``, null for ids that are made in it."""
    columns = F.struct(*notes.columns).alias("record")
    return touched.select(id_col).distinct().join(notes.select(id_col, columns), id_col, "left")


def put_back(notes: DataFrame, shot: DataFrame, id_col: str = "id") -> DataFrame:
    """``notes`` with every note of a ``snapshot`` as it was; those made since are gone, and others stay."""
    others = notes.join(shot.select(id_col), id_col, "left_anti").select(*notes.columns)
    return others.unionByName(shot.where("record is not null").select("record.*").select(*notes.columns))


def tombstones(notes: DataFrame, gone: DataFrame, id_col: str = "id") -> DataFrame:
    """The ids of imported notes that are deleted: what an import must not bring back. Own notes leave none."""
    return notes.where("not own").join(gone.select(id_col).distinct(), id_col, "left_semi").select(id_col)


def free_names(wanted: DataFrame, taken: DataFrame, by: str, name: str, made: Column, first: int = 1) -> DataFrame:
    """``wanted`` with ``free``: the name made with the smallest number from ``first`` that is not taken in its ``by``.

    ``made`` gives a name from ``name`` and the column ``k``. A name's numbers are tried only up to one more than
    its group has names, since one of those must be free.
    """
    most = taken.groupBy(by).agg(F.count("*").alias("_m"))
    tried = wanted.select(by, name).distinct().join(most, by, "left").withColumn("k", F.explode(F.sequence(F.lit(first), first + F.coalesce("_m", F.lit(0)).cast("int"))))
    tried = tried.withColumn("free", made)
    left = tried.join(taken.select(by, F.col(name).alias("free")), [by, "free"], "left_anti").groupBy(by, name).agg(F.min(F.struct("k", "free")).getField("free").alias("free"))
    return wanted.join(left, [by, name], "left")


def copy_name(name: str) -> Column:
    """``name (copy)``, ``name (copy 2)``, ..."""
    return F.concat(name, F.lit(" (copy"), F.when(F.col("k") > 1, F.concat(F.lit(" "), F.col("k").cast("string"))).otherwise(""), F.lit(")"))


def import_plan(items: DataFrame, deleted: DataFrame, by: str, kind: str, id_col: str = "id") -> DataFrame:
    """``by``, ``kind``, ``items``, ``unattached``, ``deleted_before``: what an import of ``items`` (with ``attached``) would bring."""
    mark = items.join(deleted.select(id_col, F.lit(True).alias("_gone")).distinct(), id_col, "left")
    return mark.groupBy(by, kind).agg(F.count("*").alias("items"), F.count_if(~F.col("attached")).alias("unattached"), F.count("_gone").alias("deleted_before"))


def exported(notes: DataFrame, created: str, include_imported: bool = False, id_col: str = "id") -> DataFrame:
    """Own notes, or all, with ``place``: their turn by creation, ties by id, within each ``version``."""
    kept = notes if include_imported else notes.where("own")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("version").orderBy(created, id_col)))


def cited(notes: DataFrame, citations: DataFrame, line: str, order: str, id_col: str = "id", created: str | None = None) -> DataFrame:
    """``line``, ``id_col``, ``citations``: each line's citations in order, for the note that begins on the line and was made first (``created``, ties and without it by id); a null id asks for a new note."""
    first = notes.groupBy(line).agg(F.min(F.struct(*([created] if created else []), id_col)).getField(id_col).alias(id_col))
    listed = F.array_sort(F.collect_list(F.struct(order, "citation")))
    return citations.groupBy(line).agg(F.transform(listed, lambda c: c["citation"]).alias("citations")).join(first, line, "left").select(line, id_col, "citations")


def at_points(spans: DataFrame, points: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """``point``, ``id``: notes whose text holds a character at ``idx``, ``off``. Spans are dealt to their nodes, so notes and points meet by node."""
    return anchors.pieces(spans, nodes, by).join(points.select("point", by, "idx", "off"), [by, "idx"]).where("start <= off and off < end").select("point", "id")


def fragments(nodes: DataFrame, by: str, scene: str) -> DataFrame:
    """``by``, ``idx``, ``fragment`` of nodes (``number`` null where a node has none): its number, that of the last numbered node of its scene with an offset, or the scene's with one."""
    w = Window.partitionBy(by, scene).orderBy("idx")
    told = nodes.withColumn("_at", F.last(F.when(F.col("number").isNotNull(), F.col("idx")), True).over(w)).withColumn("_no", F.last("number", True).over(w)).withColumn("_start", F.min("idx").over(Window.partitionBy(by, scene)))
    away = F.col("idx") - F.coalesce("_at", "_start")
    return told.select(by, "idx", F.concat(F.coalesce("_no", F.col(scene).cast("string")), F.when(away > 0, F.concat(F.lit("+"), away.cast("string"))).otherwise("")).alias("fragment"))


def resolved(wanted: DataFrame, nodes: DataFrame, by: str, scene: str) -> DataFrame:
    """``by``, ``fragment``, ``idx`` that fragments name: a number of a node first, else a scene within its bounds; null where neither has such a place."""
    asked = wanted.select(by, "fragment", F.split_part("fragment", F.lit("+"), F.lit(1)).alias("_base"), F.when(F.contains("fragment", F.lit("+")), F.split_part("fragment", F.lit("+"), F.lit(2)).try_cast("int")).otherwise(0).alias("_off")).distinct()
    number = nodes.where("number is not null").groupBy(by, F.col("number").alias("_base")).agg(F.min("idx").alias("_line"))
    place = nodes.groupBy(by, F.col(scene).cast("string").alias("_base")).agg(F.min("idx").alias("_start"), F.max("idx").alias("_last"))
    last = nodes.groupBy(by).agg(F.max("idx").alias("_end"))
    met = asked.join(number, [by, "_base"], "left").join(place, [by, "_base"], "left").join(last, by, "left")
    line, start = F.col("_line") + F.col("_off"), F.col("_start") + F.col("_off")
    return met.select(by, "fragment", F.when(F.col("_off") < 0, None).when(line.isNotNull(), F.when(line <= F.col("_end"), line)).when(start <= F.col("_last"), start).alias("idx"))
