"""Document order: windows over ordered rows. Every window is partitioned by what it orders within."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n, line)``: a text's lines numbered from 0."""
    return docs.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("n", "line"))


def running_offset(df: DataFrame, by: Sequence[str], order: str, width: Column, name: str = "offset") -> DataFrame:
    """The widths of all rows before this one."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(width).over(w), F.lit(0)))


def islands(df: DataFrame, by: Sequence[str], order: str, same: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows; a row where ``same`` is not true begins the next run. ``same`` may use ``lag`` over ``by``, ``order``."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("_same", same).withColumn(name, F.sum(F.when(F.col("_same"), 0).otherwise(1)).over(w)).drop("_same")


def fill_forward(df: DataFrame, by: Sequence[str], order: str, col: str) -> DataFrame:
    return df.withColumn(col, F.last(col, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order)))


def moved(df: DataFrame, by: Sequence[str], order: str, position: str, name: str = "moved") -> DataFrame:
    """Whether a row's position lies before the furthest position so far."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.col(position) < F.max(position).over(w), F.lit(False)))


def dealt(df: DataFrame, by: Sequence[str], rows: int = 250_000) -> DataFrame:
    """``df`` dealt by ``by`` to tasks of about ``rows`` rows, however many those are.

    For rows of few keys, which take few bytes when moved and many when sorted: Spark merges tasks by the former.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks, *by)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores where its files give fewer tasks than there are cores, as one row group cannot be split; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def together(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt by ``by`` to all cores, or to as many tasks as its files give: what is dealt out of a row, and later grouped or joined by ``by``, is not moved again.

    Spark deals again for a join what has fewer parts than ``spark.sql.shuffle.partitions``, so there are as many at least.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def ngrams(words: Column, n: int) -> Column:
    """Every run of ``n`` words by two hashes of it, with its place: ``array<struct<at, gram, check>>``; the words themselves are not copied."""
    places = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    of = lambda i: F.slice(words, i + 1, n)
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.xxhash64(of(i)).alias("gram"), F.hash(of(i)).alias("check")))


def recurrence(df: DataFrame, by: Sequence[str], order: str, label: str) -> DataFrame:
    """Second and later uses of a label get b, c, ..."""
    n = F.row_number().over(Window.partitionBy(*by, label).orderBy(order))
    return df.withColumn(label, F.concat(label, F.when(n > 1, F.char(96 + n)).otherwise("")))


def counterpart(entries: DataFrame, by: Sequence[str], order: str, other: str) -> DataFrame:
    """The other side's node of an entry, or of the nearest entry before it that has one."""
    return fill_forward(entries, by, order, other)


def majority(df: DataFrame, by: Sequence[str], vote: str) -> DataFrame:
    """The most frequent vote of each group, ties by value."""
    counted = df.groupBy(*by, vote).agg(F.count("*").alias("votes"))
    return counted.groupBy(*by).agg(F.min(F.struct(-F.col("votes"), vote)).alias("_m"), F.sum("votes").alias("of")).select(*by, F.col(f"_m.{vote}").alias(vote), F.col("of"))


def hash_sample(df: DataFrame, seed: str, key: Column, n: int) -> DataFrame:
    """The ``n`` rows whose salted SHA-256 comes first; the same on every run."""
    return df.withColumn("rank_hash", F.sha2(F.concat_ws(":", F.lit(seed), key), 256)).orderBy("rank_hash").limit(n)


def fill_backward(df: DataFrame, by: Sequence[str], order: str, col: str) -> DataFrame:
    """The next value at or after a row; behind the last value, the last one."""
    # seen from the end, as a frame that reaches to the end is read again for every row
    after = Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy(order)
    return df.withColumn(col, F.coalesce(F.last(col, ignorenulls=True).over(after), F.last(col, ignorenulls=True).over(before)))


def nearest(df: DataFrame, by: Sequence[str], distance: Column, ties: Sequence[str], k: int = 5) -> DataFrame:
    """The ``k`` rows of each group at the least distance, ties by ``ties``."""
    w = Window.partitionBy(*by).orderBy("_distance", *ties)
    return df.withColumn("_distance", distance).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_distance", "_rank")


def clear_best(df: DataFrame, by: Sequence[str], score: str, tie: str, lead: float = 0) -> DataFrame:
    """``(by, tie, score)`` of each group's best row, if it leads the second by more than ``lead``; groups without a clear best are left out."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), tie)
    two = df.withColumn("_rank", F.row_number().over(w)).where("_rank <= 2").groupBy(*by)
    first, second = (F.max(F.when(F.col("_rank") == n, F.struct(tie, score))) for n in (1, 2))
    told = two.agg(first.alias("_first"), second.alias("_second"))
    clear = F.col(f"_second.{score}").isNull() | (F.col(f"_first.{score}") - F.col(f"_second.{score}") > lead)
    return told.where(F.col(f"_first.{score}").isNotNull() & clear).select(*by, f"_first.{tie}", f"_first.{score}")
