"""Exact duplicates by content-defined chunk recipes.

A text without its ASCII white space is cut into chunks at places that its own characters name, so equal
texts are cut alike. Every distinct chunk is moved once, to be compared with all chunks of its 64-bit key:
a key that stands for one chunk alone is that chunk's verified identifier, and a key that several chunks
share is completed by the chunk's text. A text's recipe, its ordered identifiers, is then all that is
grouped and joined: about eight bytes a chunk, never the text again.

A null text is empty; empty texts have the empty recipe and are equal. Of equal texts the row with the
most code points in its original text stays, then that of the smallest id, null ids last, and of rows
alike in both one stays. Empty tables give empty results, and no other column of the table is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stored

#: A chunk ends behind a place that its last characters name, 128 to 8,192 code points from its start, or at the latter; letters of other scripts end it before a stop.
CHUNK = r"(?s).{123,8187}?(?:[a-h][i-p][q-z][a-h][i-p]|[^\x00-˿][,.;:!?、。])|.{1,8192}"


def plain(text: Column) -> Column:
    """The text without the characters that equality ignores; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def chunks(plain_text: Column) -> Column:
    """The chunks of a plain text in order; joined they are the text."""
    return F.regexp_extract_all(plain_text, F.lit(CHUNK), F.lit(0))


def shared_keys(texts: DataFrame, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """The keys that stand for several different chunks of column ``plain``; chunks are compared whole."""
    seen = texts.select(F.explode(chunks(F.col("plain"))).alias("chunk")).select(key(F.col("chunk")).alias("key"), "chunk").distinct()
    return seen.groupBy("key").count().where("count > 1").select("key")


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Callable[[Column], Column] = F.xxhash64, most: int = 10_000) -> DataFrame:
    """``(row, id, size, keys, spelled, sha256)`` of each row, stored.

    ``keys`` are the chunks' keys in order and ``spelled`` the texts, in order, of those chunks whose key
    stands for several; two texts are equal where both are. Beyond ``most`` such keys all chunks are spelled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.length(text).cast("long").alias("size"), plain(text).alias("plain"))
    collided = [r["key"] for r in stored(shared_keys(texts, key)).limit(most + 1).collect()]
    cut_up = texts.select("*", chunks(F.col("plain")).alias("chunks"))
    none = F.array().cast("array<string>")
    spelled = none if not collided else F.col("chunks") if len(collided) > most else F.filter("chunks", lambda c: key(c).isin(collided))
    return stored(cut_up.select(F.monotonically_increasing_id().alias("row"), "id", "size", F.transform("chunks", lambda c: key(c)).alias("keys"), spelled.alias("spelled"), F.sha2(F.col("plain").cast("binary"), 256).alias("sha256")))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Callable[[Column], Column] = F.xxhash64, hot: int = 1_000) -> DataFrame:
    """``(id_col, keep_id, group_size, kept, n_chunks, text_sha256)`` for each row of ``docs``.

    Recipes that hold at least one in ``hot`` rows, so at most ``hot`` of them, are broadcast to their
    rows, and only the others' rows are shuffled to be joined.
    """
    rows = recipes(docs, id_col, text_col, key).withColumn("head", F.xxhash64("keys", "spelled"))
    on = ["head", "keys", "spelled"]
    best = F.min(F.struct((-F.col("size")).alias("size"), F.col("id").isNull().alias("no_id"), "id", "row"))
    groups = rows.groupBy(*on).agg(F.count("*").alias("group_size"), best.alias("best")).where("group_size > 1")
    groups = stored(groups.select(*on, "group_size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row")))
    is_hot = F.col("group_size") * hot >= rows.count()
    heavy = F.broadcast(groups.where(is_hot))
    joined = rows.join(heavy, on).unionByName(rows.join(heavy, on, "left_anti").join(groups.where(~is_hot), on, "left"), allowMissingColumns=True)
    repeated = F.col("group_size").isNotNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.when(repeated, F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(repeated, F.col("keep_row") == F.col("row")).otherwise(True).alias("kept"),
        F.size("keys").alias("n_chunks"),
        F.col("sha256").alias("text_sha256"),
    )
