"""Feeds of changes and gathered answers that survive a stop at any point: nothing is lost, nothing counts twice.

A micro-batch is written to a folder of its own number, so a batch that is run again after a stop replaces what it left;
a reader takes finished folders alone. The folder must be one that the driver and all executors share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def commit(rows: DataFrame, folder: str, batch: int) -> None:
    """``rows`` as batch ``batch`` of the table in ``folder``; what the same batch left before is replaced."""
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def committed(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """All finished batches with their number, ``batch``; an empty table before the first one."""
    names = StructType([*schema.fields]).add("batch", "long")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [str(s.getPath()) for s in system.listStatus(path) if system.exists(s.getPath().suffix("/_SUCCESS"))] if system.exists(path) else []
    if not done:
        return spark.createDataFrame([], names)
    return spark.read.schema(names).option("basePath", folder).parquet(*done)


def note_changes(changes: DataFrame, folder: str, checkpoint: str, key: tuple[str, ...] = ("play", "version")) -> StreamingQuery:
    """A running query that tells, batch by batch, of which ``key`` a stream of ``changes`` has changed something.

    A subscriber reads ``committed`` beyond the last batch it knows (``news``). The query works off what there is and stops.
    """
    told = changes.select(*key)
    return told.writeStream.foreachBatch(lambda rows, batch: commit(rows.distinct(), folder, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def news(feed: DataFrame, known: int, key: tuple[str, ...] = ("play", "version")) -> DataFrame:
    """What changed after batch ``known``, once each, and the last batch that told so."""
    return feed.where(F.col("batch") > known).groupBy(*key).agg(F.max("batch").alias("batch"))


def guard(spark: SparkSession, folder: str, version: int) -> None:
    """Marks a gathered table with the version of the question asked; a table of another version is an error, as its answers cannot be mixed with new ones."""
    schema = StructType().add("version", "integer")
    found = [r["version"] for r in committed(spark, folder, schema).select("version").distinct().collect()]
    if not found:
        commit(spark.createDataFrame([(version,)], schema), folder, 0)
    elif found != [version]:
        raise ValueError(f"gathered with version {found[0]}, not {version}; move it aside to gather a new one")


def gather(asked: DataFrame, find: Callable[[DataFrame], DataFrame], folder: str, version: int, id_col: str = "id", batches: int = 8) -> DataFrame:
    """Answers to the rows of ``asked``, those of earlier runs among them: what has an answer is not asked again.

    ``find`` gives a batch's answers with ``id_col``, each row an answer; rows without one are asked in the next run. Rows are dealt
    to ``batches`` by their id, and each batch is finished before the next begins, so that a run that stops keeps
    what it has. A version other than that of the folder's answers is an error.
    """
    spark = asked.sparkSession
    guard(spark, f"{folder}/version", version)
    schema = find(asked.limit(0)).schema
    answers = f"{folder}/answers"
    before = committed(spark, answers, schema)
    last = before.agg(F.max("batch")).first()[0]
    pending = asked.join(before.select(id_col).distinct(), id_col, "left_anti")
    for k in range(batches):
        part = pending.where(F.pmod(F.xxhash64(id_col), F.lit(batches)) == k)
        if part.limit(1).count():
            commit(find(part), answers, (-1 if last is None else last) + 1 + k)
    return committed(spark, answers, schema).drop("batch")


def pruned(answers: DataFrame, asked: DataFrame, id_col: str = "id") -> DataFrame:
    """Answers to what is still asked."""
    return answers.join(asked.select(id_col).distinct(), id_col, "left_semi")
