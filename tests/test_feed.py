"""Feeds that stop and go on: batches run again, interrupted gathers, version guards."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quirework.streaming import feed

KEY = StructType().add("play", "string").add("version", "string")
CHANGE = StructType([*KEY.fields]).add("note", "integer")


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, CHANGE).coalesce(1).write.parquet(f"{folder}/{name}")


def test_a_feed_that_stops_in_the_middle_loses_and_repeats_nothing(spark, tmp_path, monkeypatch):
    source, folder, checkpoint = (str(tmp_path / x) for x in ("in", "feed", "state"))
    for i in range(4):
        put(spark, source, f"part{i}", [("p", f"v{i}", 1), ("p", f"v{i}", 2), ("q", "w", i)])
    stream = lambda: spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    real, runs = feed.commit, []

    def stopping(rows, folder, batch):
        real(rows, folder, batch)
        runs.append(batch)
        if runs == [0, 1, 2]:  # written, but not yet known to be done
            raise RuntimeError("lost")

    monkeypatch.setattr(feed, "commit", stopping)
    with pytest.raises(Exception, match="lost"):
        feed.note_changes(stream(), folder, checkpoint).awaitTermination()
    feed.note_changes(stream(), folder, checkpoint).awaitTermination()
    assert runs == [0, 1, 2, 2, 3]
    got = feed.committed(spark, folder, KEY)
    assert sorted((r.play, r.version) for r in got.collect()) == sorted([("p", f"v{i}") for i in range(4)] + [("q", "w")] * 4)
    told = feed.news(got, 1)
    assert len(told.collect()) == 3 and {r.batch for r in told.where("play = 'q'").collect()} == {3}
    assert feed.news(got, 3).collect() == []
    # what comes later is told in a further batch
    put(spark, source, "late", [("r", "x", 1)])
    feed.note_changes(stream(), folder, checkpoint).awaitTermination()
    assert [tuple(r) for r in feed.news(feed.committed(spark, folder, KEY), 3).collect()] == [("r", "x", 4)]


def test_unfinished_batches_are_not_read(spark, tmp_path):
    folder = str(tmp_path / "feed")
    assert feed.committed(spark, folder, KEY).collect() == []
    feed.commit(spark.createDataFrame([("p", "v")], KEY), folder, 0)
    feed.commit(spark.createDataFrame([("p", "half")], KEY), folder, 1)
    (tmp_path / "feed" / "batch=1" / "_SUCCESS").unlink()
    assert [tuple(r) for r in feed.committed(spark, folder, KEY).collect()] == [("p", "v", 0)]
    feed.commit(spark.createDataFrame([("p", "whole")], KEY), folder, 1)
    assert sorted(r.version for r in feed.committed(spark, folder, KEY).collect()) == ["v", "whole"]


def test_a_gather_goes_on_where_it_stopped(spark, tmp_path):
    folder, asked_for, fail = str(tmp_path / "gathered"), [], [3]
    lines = spark.range(40).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("phrase "), "id").alias("phrase"))

    def find(rows):
        ids = sorted(r.id for r in rows.collect())
        if ids:
            if not fail[0]:
                raise RuntimeError("lost")
            fail[0] -= 1
            asked_for.extend(ids)
        # every tenth has no answer in the first run
        return rows.where(F.lit(len(asked_for) > 40) | (F.col("id") % 10 != 0)).select("id", F.concat(F.lit("works of "), "phrase").alias("works"))

    with pytest.raises(RuntimeError, match="lost"):
        feed.gather(lines, find, folder, 1)
    fail[0] = 99
    got = feed.gather(lines, find, folder, 1).collect()
    first = sorted(asked_for)
    assert len(got) == len({r.id for r in got}) and {r.id for r in got} >= {i for i in range(40) if i % 10}
    # answered lines were asked once; those without answer again
    again = [i for i in range(40) if first.count(i) > 1]
    assert all(i % 10 == 0 for i in again) and set(first) == set(range(40))
    asked_for.extend([-1] * 41)
    got = feed.gather(lines, find, folder, 1)
    assert sorted(r.id for r in got.collect()) == list(range(40))
    before = len(asked_for)
    feed.gather(lines, find, folder, 1)
    assert len(asked_for) == before
    assert sorted(r.id for r in feed.pruned(got, lines.where("id < 5")).collect()) == [0, 1, 2, 3, 4]


def test_answers_of_another_version_are_not_mixed(spark, tmp_path):
    folder = str(tmp_path / "gathered")
    lines = spark.createDataFrame([(1, "a")], "id int, phrase string")
    feed.gather(lines, lambda rows: rows, folder, 1)
    with pytest.raises(ValueError, match="version 1, not 2"):
        feed.gather(lines, lambda rows: rows, folder, 2)


def test_a_session_is_put_back(spark):
    from quirework.operators import notes

    note = "id int, text string, modified boolean"
    then = spark.createDataFrame([(1, "a", False), (2, "b", True), (3, "c", False)], note)
    shot = notes.snapshot(then, spark.createDataFrame([(1,), (2,), (9,)], "id int"))
    now = spark.createDataFrame([(1, "A", True), (3, "C", True), (9, "new", False), (8, "other", False)], note)
    assert sorted(tuple(r) for r in notes.put_back(now, shot).collect()) == [(1, "a", False), (2, "b", True), (3, "C", True), (8, "other", False)]
    assert sorted(tuple(r) for r in notes.put_back(now, shot.limit(0)).collect()) == sorted(tuple(r) for r in now.collect())
