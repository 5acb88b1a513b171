"""Keyed tables that are merged: imported collections, stable ids, change logs, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def import_merge(local: DataFrame, incoming: DataFrame, deleted: DataFrame, restored: DataFrame, id_col: str = "id", rank: str = "n") -> DataFrame:
    """``(id_col, outcome)`` of merging a file into a collection.

    ``local`` has ``id_col`` and ``modified``; ``incoming`` has ``id_col`` and its place ``rank``, of
    repeated ids the first counts; ``deleted`` holds tombstones and ``restored`` ids to bring back.
    """
    first = incoming.groupBy(id_col).agg(F.min(rank).alias("at"))
    mark = lambda df, name: df.select(id_col).distinct().withColumn(name, F.lit(True))
    both = local.select(id_col, "modified", F.lit(True).alias("here")).join(first, id_col, "full").join(mark(deleted, "gone"), id_col, "left").join(mark(restored, "back"), id_col, "left")
    comes, changed = F.col("at").isNotNull(), F.coalesce("modified", F.lit(False))
    outcome = (
        F.when(~comes & changed, "keptModified")
        .when(~comes, "removed")
        .when(F.col("gone") & F.col("back").isNull(), "previouslyDeleted")
        .when(F.col("here") & changed, "keptModified")
        .when(F.col("here"), "updated")
        .when(F.col("back"), "restored")
        .otherwise("added")
    )
    return both.select(id_col, outcome.alias("outcome"))


def stable_ids(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """``(key, status)`` of two revisions (``key``, ``text``): kept, changed, removed or new; repeated keys raise."""
    once = lambda df: df.groupBy(key).agg(F.first("text").alias("text"), F.count("*").alias("c")).select(key, F.when(F.col("c") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string"))).cast("string")).otherwise(F.col("text")).alias("text"), F.lit(True).alias("there"))
    both = once(old).join(once(new).withColumnsRenamed({"text": "new_text", "there": "new_there"}), key, "full")
    status = F.when(F.col("there").isNull(), "new").when(F.col("new_there").isNull(), "removed").when(F.col("text").eqNullSafe(F.col("new_text")), "kept").otherwise("changed")
    return both.select(key, status.alias("status"))


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of ``changes`` put in place of those of the same key."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes.select(*table.columns))


def latest(events: DataFrame, key: list[str], ts: str, value: str, tie: str) -> DataFrame:
    """The last value written for each key; of equal times the larger ``tie``."""
    return events.groupBy(*key).agg(F.max(F.struct(ts, tie, value)).alias("m")).select(*key, f"m.{ts}", f"m.{value}")
