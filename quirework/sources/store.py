"""Tables by key in a folder: loading what a key has, settings with defaults, versions of a store, and sorted lines for review."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file systems have something at ``path``."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def load(spark: SparkSession, folder: str, name: str, schema: StructType, required: bool = False, **key: str) -> DataFrame:
    """The rows of table ``name`` that have ``key``, its partition columns, so that other keys' files are not read.

    A table that is not there, or a key that has no rows, is an error if ``required``, else empty. Records that are
    not of ``schema`` stop the job.
    """
    path = f"{folder}/{name}"
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path) if exists(spark, path) else spark.createDataFrame([], schema)
    for column, value in key.items():
        rows = rows.where(F.col(column) == value)
    if required and not rows.limit(1).count():
        raise KeyError(f"no {name} of {', '.join(f'{k} {v}' for k, v in key.items()) or folder}")
    return rows


def save(rows: DataFrame, folder: str, name: str, by: Sequence[str] = ()) -> None:
    """``rows`` as JSON, a folder for each value of ``by``, in place of what these values had."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).json(f"{folder}/{name}")


def version_view(tables: dict[str, DataFrame], main: str, key: Sequence[str]) -> DataFrame:
    """One row for each key of table ``main`` with the rows of every table, by name, as an array; a table without rows of a key gives an empty one."""
    told = tables[main].select(*key).distinct()
    for name, rows in tables.items():
        row = F.struct(*[c for c in rows.columns if c not in key])
        told = told.join(rows.groupBy(*key).agg(F.collect_list(row).alias(name)), list(key), "left")
        told = told.withColumn(name, F.coalesce(name, F.array().cast(told.schema[name].dataType)))
    return told


def setting(settings: DataFrame, name: str, default: Column) -> Column:
    """A setting's value as a column expression over one looked-up row; unset, or of no use as the default's type, it is the default."""
    found = settings.where(F.col("name") == name).select("value").limit(1).collect()
    value = F.lit(found[0]["value"] if found else None).cast("string")
    return F.coalesce(value, default.cast("string"))


def upgraded(rows: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]], version: str = "schema_version") -> DataFrame:
    """``rows`` of any version brought to the latest: of ``steps``, which are only ever added to, each row takes those it has not had.

    A version beyond the steps was written by a later program and is an error.
    """
    latest = len(steps)
    late = rows.where(F.coalesce(F.col(version), F.lit(0)) > latest).limit(1).collect()
    if late:
        raise ValueError(f"stored with version {late[0][version]}, beyond {latest}")
    found = sorted(r[0] for r in rows.select(F.coalesce(F.col(version), F.lit(0))).distinct().collect())  # at most one for each step
    out = None
    for begin in found or [0]:
        part = rows.where(F.coalesce(F.col(version), F.lit(0)) == begin)
        for step in steps[begin:]:
            part = step(part)
        part = part.withColumn(version, F.lit(latest))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def published(df: DataFrame) -> str:
    """A table's schema as JSON text, for others to check against."""
    return df.schema.json()


def write_lines(rows: DataFrame, path: str, *order: str) -> None:
    """``rows`` as lines of JSON in order, one entry a line, so that a review shows what changed; files follow one another by name."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``write_lines`` has written; lines that are not of ``schema`` stop the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
