"""Importance resampling towards a target collection by external sort-count over hashed n-grams.

Words are runs of letters A-Z (lower-cased), digits and anything beyond ASCII. Features are all runs of
one to three words joined by a space, and a feature's bucket is its CRC-32 modulo ``BUCKETS``. Texts are
read once: tasks write their buckets as packed uint16 streams with the offset at which each document ends.
Counting sorts each stream and run-length encodes it, and Spark adds up the runs by bucket. A later pass
gathers each stream's gains and adds them up by document with ``np.add.reduceat``.

A null text has no words; a document without features weighs 0. Null ids hash as the empty text, rows
alike score alike and follow each other in rank. Empty tables give empty results (an empty target has no
counts, and every gain follows from the smoothing alone). No other column of the tables is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BUCKETS = 10_000
#: Features after which a stream is closed, so that a batch of streams stays small; a longer document may be a stream of its own.
STREAM = 1 << 15

_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def buckets(found: list[bytes]) -> np.ndarray:
    """The buckets of all runs of one to three words; a longer run's checksum goes on from the shorter one's."""
    one = list(map(crc32, found))
    spaced = [b" " + w for w in found]
    two = list(map(crc32, spaced[1:], one))
    three = list(map(crc32, spaced[2:], two))
    return (np.array([*one, *two, *three], dtype=np.uint32) % BUCKETS).astype(np.uint16)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        begin, held, sizes, parts = 0, 0, [], []
        for at, text in enumerate(batch.column("text")):
            found = words(text.as_py())
            parts.append(buckets(found))
            sizes.append(len(found))
            held += len(parts[-1])
            if held >= STREAM:
                yield _packed(batch, begin, sizes, parts)
                begin, held, sizes, parts = at + 1, 0, [], []
        if sizes:
            yield _packed(batch, begin, sizes, parts)


def _packed(batch: pa.RecordBatch, begin: int, sizes: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
    """One row: the ids and word counts of the stream's documents, where each ends in it, and the stream."""
    whole = pa.array([0, len(sizes)], pa.int32())
    lists = [pa.ListArray.from_arrays(whole, x) for x in (batch.column("id").slice(begin, len(sizes)), pa.array(sizes, pa.int64()), pa.array(np.cumsum([len(p) for p in parts]), pa.int64()))]
    return pa.RecordBatch.from_arrays([*lists, pa.array([np.concatenate(parts).tobytes()], pa.binary())], ["ids", "words", "ends", "stream"])


def streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed streams of ``docs``, stored."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(_streams, f"ids array<{kind}>, words array<long>, ends array<long>, stream binary"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for stream in batch.column("stream"):
            ordered = np.sort(np.frombuffer(stream.as_buffer(), dtype=np.uint16))
            starts = np.flatnonzero(np.diff(ordered, prepend=np.uint16(BUCKETS)))
            total[ordered[starts]] += np.diff(starts, append=len(ordered))
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])


def counts(packed: DataFrame) -> np.ndarray:
    """How often each bucket occurs: streams sorted and run-length encoded in tasks, their runs added up by Spark."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for r in packed.select("stream").mapInArrow(_runs, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r["bucket"]] = r["n"]
    return total


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the floor of 1,000 times the log ratio of its smoothed shares of the target and of the raw collection."""
    s_all, t_all = int(raw.sum()), int(target.sum())
    ratio = lambda s, t: (float(t + 1) * float(s_all + BUCKETS)) / (float(s + 1) * float(t_all + BUCKETS))
    return np.array([math.floor(1000 * math.log(ratio(int(s), int(t)))) for s, t in zip(raw, target, strict=True)], dtype=np.int64)


def weights(packed: DataFrame, gain: np.ndarray, id_kind: str = "bigint") -> DataFrame:
    """``(id, n_words, n_features, weight)`` of each document of the streams."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, ends, stream in zip(*(batch.column(c) for c in ("ids", "words", "ends", "stream")), strict=True):
                end = np.asarray(ends.values)
                length = np.diff(end, prepend=0)
                sums = np.zeros(len(end), dtype=np.int64)
                full = length > 0
                if full.any():
                    # documents without features share their start with the next one and are left out of the sums
                    sums[full] = np.add.reduceat(gain[np.frombuffer(stream.as_buffer(), dtype=np.uint16)], (end - length)[full])
                yield pa.RecordBatch.from_arrays([ids.values, sizes.values, pa.array(length), pa.array(sums)], ["id", "n_words", "n_features", "weight"])

    return packed.mapInArrow(weigh, f"id {id_kind}, n_words long, n_features long, weight long")


def noise(id_col: Column, seed: int) -> Column:
    """Standard Gumbel noise in thousandths, rounded down, from the id's hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000) * F.log(-F.log(u)))


def resample(docs: DataFrame, target: DataFrame, share: int = 5, least: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text") -> DataFrame:
    """``(id_col, n_words, n_features, weight, score, rank)`` of each row of ``docs``.

    Of the rows with at least ``least`` words the best ``share`` percent, rounded down, get a rank, as the
    highest sums of weight and noise are a draw without replacement in proportion to ``exp(weight / 1000)``.
    """
    packed = streams(docs, id_col, text_col)
    gain = gains(counts(packed), counts(streams(target, target_id, target_text)))
    kind = docs.schema[id_col].dataType.simpleString()
    scored = weights(packed, gain, kind).select("*", (F.col("weight") + noise(F.col("id"), seed)).alias("score"))
    # dealt by range of the order, stored with each row's place in its range; the ranges' sizes give the ranks
    able = (F.col("n_words") >= least).alias("able")
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("id")]
    dealt = scored.select("*", able).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(dealt.select("*", F.monotonically_increasing_id().alias("place")))
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("able").alias("m")).orderBy("part").collect()
    begin, seen = {}, 0
    for r in sizes:
        begin[r["part"]], seen = seen, seen + r["n"]
    drawn = share * sum(r["m"] for r in sizes) // 100
    begins = docs.sparkSession.createDataFrame(list(begin.items()) or [(0, 0)], "part long, begin long")
    rank = F.col("begin") + at + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(begins), "part")
    return ranked.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
