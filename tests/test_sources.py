"""File scans and streams against small cases."""

import io
import tarfile

import pytest
from pyspark.sql import functions as F

from quirework.sources import files
from quirework.streaming import changes


def test_tar_members_and_digest(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for name, data in (("x/one.txt", b"caf\xe9\ntea\ntea\n"), ("two.txt", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    found = files.tar_members(files.files(spark, str(tmp_path / "a.tar.gz")))
    assert {(r.member, bytes(r.content)) for r in found.collect()} == {("x/one.txt", b"caf\xe9\ntea\ntea\n"), ("two.txt", b"")}
    assert {r.word for r in files.word_list(found).collect()} == {"café", "tea"}
    with pytest.raises(Exception, match="digest differs"):
        files.files(spark, str(tmp_path / "a.tar.gz"), "0" * 64).collect()


def test_ris(spark):
    text = "TY  - JOUR\nTI  - On Ghosts\nAU  - Roe, J.\nAU  - Doe, A.\nPY  - 1999/03\nER  - \nTY  - BOOK\nT1  - Other\nDO  - 10.1/x\nER  -\n"
    got = files.ris(spark.createDataFrame([("f", text), ("g", None), ("h", "")], "path string, text string")).orderBy("n").collect()
    assert [(r.path, r.n, r.title, r.authors, r.year, r.doi) for r in got] == [("f", 0, "On Ghosts", ["Roe, J.", "Doe, A."], 1999, None), ("f", 1, "Other", [], None, "10.1/x")]


def test_streams_agree_with_batches(spark, tmp_path):
    events = changes.timed(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "ts")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    of = lambda df: changes.positions(df, ["user_id"], "ts", "value", "event_id")
    run = of(stream).writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("seen").collect())) == sorted(map(tuple, of(events).collect()))
    assert changes.sessions(events, ["user_id"], "ts", "6 hours").agg(F.sum("n")).first()[0] == events.count()
    assert changes.sessions(stream, ["user_id"], "ts").isStreaming
