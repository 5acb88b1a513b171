"""Lookups, ordered groupings and checks between keyed tables. All are joins, aggregates and windows with a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def toggled(rows: DataFrame, settings: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is switched on; what ``settings`` (``key``, ``enabled``) does not list is on."""
    return rows.join(settings.select(key, F.col("enabled").alias("_on")), key, "left").where(F.coalesce("_on", F.lit(True))).drop("_on")


def fallback_join(rows: DataFrame, exact: DataFrame, loose: DataFrame, key: str, loose_key: str, value: str) -> DataFrame:
    """``value`` by ``key``, else by ``loose_key`` where that names one value alone; neither gives null."""
    only = loose.groupBy(loose_key).agg(F.min(value).alias("_only"), F.countDistinct(value).alias("_n")).where("_n = 1").drop("_n")
    return rows.join(exact.select(key, F.col(value).alias("_exact")), key, "left").join(only, loose_key, "left").withColumn(value, F.coalesce("_exact", "_only")).drop("_exact", "_only")


def pending(wanted: DataFrame, answered: DataFrame, key: str) -> DataFrame:
    """What is still to be asked: wanted rows without an answer."""
    return wanted.join(answered.select(key).distinct(), key, "left_anti")


def pruned(answered: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Answers to what is still wanted."""
    return answered.join(wanted.select(key).distinct(), key, "left_semi")


def first_candidate(rows: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """The first value of each group that is not null; groups without any have null."""
    return rows.groupBy(*by).agg(F.min(F.when(F.col(value).isNotNull(), F.struct(order, value))).alias("_f")).select(*by, F.col(f"_f.{value}").alias(value))


def ordered_groups(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``key``, ``values`` in order, and ``place``, where the key first occurs; groups are meant in the order of ``place``."""
    listed = F.array_sort(F.collect_list(F.struct(order, value)))
    return rows.groupBy(key).agg(F.min(order).alias("place"), F.transform(listed, lambda x: x[value]).alias("values"))


def distinct_in_order(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``key`` and its distinct values in the order in which they first occur."""
    first = rows.groupBy(key, value).agg(F.min(order).alias("_at"))
    listed = F.array_sort(F.collect_list(F.struct("_at", value)))
    return first.groupBy(key).agg(F.transform(listed, lambda x: x[value]).alias("values"))


def merged_entities(rows: DataFrame, id_col: str, key: Column) -> DataFrame:
    """``id_col`` and ``merged``, the smallest id with the same key; an empty key stands alone."""
    keyed = rows.select(id_col, key.alias("_key"))
    least = keyed.where("_key <> ''").groupBy("_key").agg(F.min(id_col).alias("_least"))
    return keyed.join(least, "_key", "left").select(id_col, F.coalesce("_least", id_col).alias("merged"))


def best_by_weight(rows: DataFrame, by: Sequence[str], candidate: str, weight: Column) -> DataFrame:
    """The candidate of each group with the largest sum of weights, ties by the smaller candidate."""
    summed = rows.groupBy(*by, candidate).agg(F.round(F.sum(weight), 9).alias("_w"))
    return summed.groupBy(*by).agg(F.min(F.struct((-F.col("_w")).alias("_o"), candidate)).alias("_b")).select(*by, F.col(f"_b.{candidate}").alias(candidate), (-F.col("_b._o")).alias("weight"))


def neighbours(rows: DataFrame, by: Sequence[str], order: str, col: str, reach: int = 1) -> DataFrame:
    """``rows`` with ``before`` and ``after``: the values up to ``reach`` rows away, joined by a bar."""
    w = Window.partitionBy(*by).orderBy(order)
    side = lambda a, b: F.array_join(F.collect_list(col).over(w.rowsBetween(a, b)), "|")
    return rows.withColumn("before", side(-reach, -1)).withColumn("after", side(1, reach))


def following(rows: DataFrame, by: Sequence[str], order: str, words: Column, least: int, most: int) -> DataFrame:
    """``rows`` with ``phrase``: its words and those of the rows after it until there are ``least``, cut to ``most``; null where the group ends before."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.currentRow, least - 1)
    ahead = rows.withColumn("_w", words).withColumn("_rows", F.collect_list("_w").over(w))
    taken = F.aggregate("_rows", F.array().cast("array<string>"), lambda a, x: F.when(F.size(a) >= least, a).otherwise(F.concat(a, x)))
    return ahead.withColumn("_t", taken).withColumn("phrase", F.when(F.size("_t") >= least, F.array_join(F.slice("_t", 1, most), " "))).drop("_w", "_rows", "_t")


def first_reason(checks: dict[str, Column]) -> Column:
    """The name of the first check that holds; null if none does."""
    return F.coalesce(*[F.when(holds, name) for name, holds in checks.items()])


def batched(rows: DataFrame, by: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """``rows`` with ``batch``: every ``most`` rows of a group in order make one."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / most).cast("int"))


def natural_key(c: Column, width: int = 12) -> Column:
    """A key that sorts text by its letters and its runs of digits by their value."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), 1), lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, width, "0")).otherwise(x)), "")


def shared_words(a: Column, b: Column) -> Column:
    """How many distinct words two arrays share."""
    return F.size(F.array_intersect(a, b))


def truncated(c: Column, most: int) -> Column:
    """At most ``most`` characters, the last one an ellipsis where something is cut."""
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…"))).otherwise(c)


def change_log(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and ``change`` (added, removed or changed) between two revisions; what is equal is left out."""
    both = old.select(key, F.col(text).alias("_o"), F.lit(True).alias("_a")).join(new.select(key, F.col(text).alias("_n"), F.lit(True).alias("_b")), key, "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_n")), "changed")
    return both.select(key, change.alias("change")).where("change is not null")
