"""What the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data: the session's ``spark.checkpoint.dir``.

    Where the session names none, a local master gets a temporary folder, as in tests; on a cluster
    that is an error, as executors do not share the driver's folders.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def bound_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """From now on Python workers of the session get at most ``rows`` rows at a time, as texts may be long; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, read from the reliable checkpoint folder from now on."""
    shared_folder(df.sparkSession)
    bound_batches(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read from there, column by column."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    bound_batches(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def fold(id_col: str, k: int) -> Column:
    """``crc32(id as text) mod k``; a null id is text ``''``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % k


def first_hashes(share: float) -> int:
    """The last of the first ``share`` of all 64-bit hashes: all of them at 1, and fine enough for any table."""
    return min(2**63 - 1, int(share * 2**64) - 2**63)


def words(col: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), SPACE), lambda w: w != "")


def small(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows; reads ``limit + 1`` rows at most."""
    return df.limit(limit + 1).count() <= limit


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores in front until no column of ``taken`` has it, whatever its case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; dealt to all cores where its files give fewer tasks than there are cores, as one row group cannot be split."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df
