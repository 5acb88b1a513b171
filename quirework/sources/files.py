"""Scans of archives, word lists and bibliographies, a row a record. Files are spread over tasks by ``binaryFile``."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """``path`` and ``content``; with ``sha256`` given, content of another digest raises."""
    found = spark.read.format("binaryFile").load(path).select("path", "content")
    if sha256 is None:
        return found
    right = F.sha2("content", 256) == sha256.lower()
    return found.select("path", F.when(right, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("digest differs: "), "path"))).alias("content"))


def word_list(archives: DataFrame, encoding: str = "ISO-8859-1", lists: list[str] | None = None, most: int | None = None) -> DataFrame:
    """The distinct words of files (``content``) with a word a line, in lower case, with plain apostrophes.

    With ``lists`` or ``most``, files (``member``) are named ``list.size``: only those lists and sizes up to ``most`` are read.
    """
    if lists is not None or most is not None:
        name = F.split(F.element_at(F.split("member", "/"), -1), r"\.")
        size = F.try_element_at(name, F.lit(2)).try_cast("int")
        archives = archives.where((F.element_at(name, 1).isin(lists) if lists is not None else F.lit(True)) & (size <= most if most is not None else size.isNotNull()))
    lines = archives.select(F.explode(F.split(F.decode("content", encoding), r"\r?\n")).alias("line"))
    return lines.select(F.translate(F.lower(F.trim("line")), "’", "'").alias("word")).where("word <> ''").distinct()


def zip_members(archives: DataFrame, member: str | None = None) -> DataFrame:
    """``path``, ``member``, ``content`` of the files in zip archives, or of the one named ``member``. An archive is one task's work, a file in it one row."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, content in zip(rows["path"], rows["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for m in archive.infolist():
                        if not m.is_dir() and member in (None, m.filename):
                            yield pd.DataFrame({"path": [path], "member": [m.filename], "content": [archive.read(m)]})

    return archives.select("path", "content").mapInPandas(of, "path string, member string, content binary")


def tar_members(archives: DataFrame) -> DataFrame:
    """``path``, ``member``, ``content`` of the regular files in tar archives, compressed or not. An archive is one task's work."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, content in zip(rows["path"], rows["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                    for m in archive:
                        if m.isfile():
                            yield pd.DataFrame({"path": [path], "member": [m.name], "content": [archive.extractfile(m).read()]})

    return archives.select("path", "content").mapInPandas(of, "path string, member string, content binary")


def ris(texts: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """The works of RIS files: ``id_col``, ``n`` (place in its file), title, authors, year, doi. Records end at ``ER``; of repeated single fields the first counts."""
    record = texts.select(id_col, F.posexplode(F.split(text_col, r"(?m)^ER  -.*$")).alias("n", "record"))
    line = record.select(id_col, "n", F.posexplode(F.split("record", r"\r?\n")).alias("at", "line"))
    tagged = line.select(id_col, "n", "at", F.regexp_extract("line", "^([A-Z][A-Z0-9])  -", 1).alias("tag"), F.trim(F.substring("line", 7, 1_000_000)).alias("value")).where("tag <> '' and value <> ''")
    one = lambda *tags: F.min(F.when(F.col("tag").isin(*tags), F.struct("at", "value"))).getField("value")
    people = F.array_sort(F.collect_list(F.when(F.col("tag").isin("AU", "A1"), F.struct("at", "value"))))
    year = F.regexp_extract(one("PY", "Y1"), r"(\d{4})", 1).try_cast("int")
    return tagged.groupBy(id_col, "n").agg(one("TI", "T1").alias("title"), F.transform(people, lambda p: p["value"]).alias("authors"), year.alias("year"), one("DO").alias("doi"))


#: A BibTeX value: braces up to three deep, a quoted string, or a bare word.
_VALUE = r"(\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}|\"[^\"]*\"|\w+)"


def bibtex(texts: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """The works of BibTeX files, in the columns of ``ris``. Entries begin at ``@`` in a line's beginning; those without a title go; of repeated fields the last counts."""
    entry = texts.select(id_col, F.posexplode(F.split(text_col, r"(?m)(?=^\s*@\w+\s*\{)")).alias("n", "entry")).where(F.col("entry").rlike(r"^\s*@\w+\s*\{"))
    field = rf"[,\s](\w[\w-]*)\s*=\s*{_VALUE}"
    every = lambda g: F.regexp_extract_all("body", F.lit(field), F.lit(g))
    body = entry.withColumn("body", F.regexp_replace("entry", r"^\s*@\w+\s*\{[^,]*,", ","))
    pairs = body.withColumn("f", F.arrays_zip(F.transform(every(1), F.lower).alias("k"), every(2).alias("v")))
    bare = lambda v: F.trim(F.regexp_replace(F.regexp_replace(v, r'[{}]|^"|"$', ""), r"\s+", " "))
    value = lambda *keys: F.coalesce(*[F.try_element_at(F.filter("f", lambda p: p["k"] == k), F.lit(-1))["v"] for k in keys])
    safe = pairs.withColumn("f", F.when(F.size("f") > 0, F.col("f")))
    people = F.filter(F.transform(F.split(F.coalesce(bare(value("author", "editor")), F.lit("")), r"\s+and\s+"), F.trim), lambda a: a != "")
    year = F.regexp_extract(value("year", "date"), r"(\d{4})", 1).try_cast("int")
    told = safe.select(id_col, "n", bare(value("title")).alias("title"), people.alias("authors"), year.alias("year"), bare(value("doi")).alias("doi")).where("title <> ''")
    return told.withColumn("n", (F.row_number().over(Window.partitionBy(id_col).orderBy("n")) - 1).cast("int"))


def csl_json(texts: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """The works of CSL-JSON files, one or an array, in the columns of ``ris``; items without a title and texts that are no JSON go."""
    item = "array<struct<title string, author array<struct<family string, given string, literal string>>, issued struct<`date-parts` array<array<string>>>, DOI string>>"
    one = texts.select(id_col, F.posexplode(F.from_json(text_col, item)).alias("n", "i")).where("i.title <> ''")
    named = F.transform(F.coalesce("i.author", F.expr("cast(array() as array<struct<family string, given string, literal string>>)")), lambda a: F.coalesce(a["literal"], F.concat_ws(", ", a["family"], a["given"])))
    year = F.try_element_at(F.try_element_at(F.col("i.issued.`date-parts`"), F.lit(1)), F.lit(1)).try_cast("int")
    return one.select(id_col, "n", F.col("i.title").alias("title"), named.alias("authors"), year.alias("year"), F.col("i.DOI").alias("doi"))


def bibliography(texts: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """The works of files in BibTeX, RIS or CSL-JSON, told apart by how they begin; other texts have none."""
    text = F.trim(F.regexp_replace(text_col, r"^\s+", ""))
    kind = F.when(text.startswith("@"), "bibtex").when(text.rlike(r"(?m)^TY\s{1,2}-"), "ris").when(text.rlike(r"^[\[{]"), "csl")
    told = texts.withColumn("_kind", kind)
    of = lambda name, scan: scan(told.where(F.col("_kind") == name), id_col, text_col)
    return of("bibtex", bibtex).unionByName(of("ris", ris)).unionByName(of("csl", csl_json))
