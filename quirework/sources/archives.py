"""Archives of notes: a ZIP file a collection, with its notes and, if it has any, its cuts as JSON.

Reading refuses a file that is too large, is no ZIP file, is damaged, holds no notes, or is of another format or a
newer version, and counts what it rejects of the rest: every record is held against the format by itself, so that a bad
one neither passes nor hides the others. Entries are inflated up to a bound and no further. ``whole`` files have no
reject. Writing and reading agree: what is written is read back as it was. Null contents are no ZIP file; empty
tables give empty results.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.kept import kept

PARTS_OF_SPEECH = ("noun", "verb", "adjective", "adverb", "pronoun", "preposition", "conjunction", "interjection", "phrase", "other")


@dataclass(frozen=True)
class Layout:
    """Names of the entries and formats, and the bounds."""

    notes: str = "notes.json"
    cuts: str = "cuts.json"
    notes_format: str = "notes"
    cuts_format: str = "cuts"
    version: int = 1
    archive_bytes: int = 10 << 20
    json_bytes: int = 50 << 20
    meaning: int = 5_000
    text: int = 100_000
    cut_text: int = 5_000


def _inflated(content: bytes | None, layout: Layout) -> tuple[str | None, str | None, str | None]:
    """Why an archive is refused, or its notes and cuts; inflating stops at the bound, whatever sizes the archive tells."""
    if content is not None and len(content) > layout.archive_bytes:
        return "archive too large", None, None
    if not content or content[:4] != b"PK\x03\x04":
        return "not a ZIP file", None, None
    told: dict[str, str] = {}
    left = layout.json_bytes
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for name in (layout.notes, layout.cuts):
                if name in archive.namelist():
                    with archive.open(name) as entry:
                        data = entry.read(left + 1)
                    left -= len(data)
                    if left < 0:
                        return "notes too large", None, None
                    told[name] = data.decode("utf-8", "replace")
    except (zipfile.BadZipFile, EOFError, ValueError, NotImplementedError, RuntimeError, OSError, zlib.error):
        return "damaged ZIP file", None, None
    return (None, told[layout.notes], told.get(layout.cuts)) if layout.notes in told else ("no notes in it", None, None)


def opened(files: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """``path``, ``refused``, ``notes``, ``cuts`` of archives (``path``, ``content``)."""

    names = ("path", "refused", "notes", "cuts")
    arrays.bounded(files.sparkSession)
    of = arrays.batched(lambda path, content: (path, *_inflated(content, layout)), pa.schema([(c, pa.string()) for c in names]))
    return files.select("path", "content").mapInArrow(of, ", ".join(f"{c} string" for c in names))


def _kind(v: Column, path: str) -> Column:
    """The type of what a JSON value holds at a path: ``STRING``, ``BIGINT``, ``OBJECT<...>``, ...; null where it holds nothing."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _text(v: Column, path: str) -> Column:
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def _is(kind: Column, name: str) -> Column:
    return F.coalesce(kind.startswith(name), F.lit(False))


def _string(v: Column, path: str, least: int = 0, optional: bool = False) -> Column:
    fits = F.coalesce(F.length(_text(v, path)) >= least, F.lit(False))
    return fits | _kind(v, path).isNull() if optional else fits


def _whole(v: Column, path: str) -> Column:
    """A whole number that is not negative."""
    return _is(_kind(v, path), "BIGINT") & F.coalesce(F.try_variant_get(v, path, "bigint") >= 0, F.lit(False))


def _items(v: Column, path: str) -> Column:
    """The items of an array that a JSON value holds at a path; null for anything else. Its type, told otherwise, would read every item."""
    return F.try_variant_get(v, path, "array<variant>")


def _each(v: Column, path: str, fits) -> Column:
    """Whether a value holds an array at a path and each of its items fits."""
    return F.coalesce(F.forall(_items(v, path), fits), F.lit(False))


def _first(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that fails, null where none does."""
    return F.coalesce(*[F.when(~ok, F.lit(name)) for name, ok in checks])


def _anchor(v: Column, at: str = "$.anchor") -> list[tuple[str, Column]]:
    ends = [(f"{at[2:]}.{end}", _string(v, f"{at}.{end}.nodeId", 1) & _whole(v, f"{at}.{end}.offset")) for end in ("start", "end")]
    return [*ends, (f"{at[2:]}.quote", _string(v, f"{at}.quote.exact", 1) & _string(v, f"{at}.quote.prefix") & _string(v, f"{at}.quote.suffix")), (f"{at[2:]}.revision", _string(v, f"{at}.revision"))]


def _item(v: Column) -> list[tuple[str, Column]]:
    return [("id", _string(v, "$.id", 1)), ("versionId", _string(v, "$.versionId", 1)), *_anchor(v), ("createdAt", _string(v, "$.createdAt")), ("updatedAt", _string(v, "$.updatedAt"))]


def _checks(v: Column, layout: Layout) -> dict[str, list[tuple[str, Column]]]:
    """What each kind of record must be, in the order of its fields."""
    short = lambda path, most: ("too long", F.coalesce(F.length(_text(v, path)) <= most, F.lit(True)))
    part = F.coalesce(_text(v, "$.partOfSpeech").isin(*PARTS_OF_SPEECH), F.lit(False)) | _kind(v, "$.partOfSpeech").isNull()
    link = lambda x: _string(x, "$.url") & _string(x, "$.label", optional=True)
    cite = lambda x: _string(x, "$.type") & _string(x, "$.title")
    operation = lambda x: _string(x, "$.id", 1) & F.coalesce(
        F.when(_text(x, "$.type") == "insert", _string(x, "$.after", 1) & _text(x, "$.kind").isin("sd", "narration") & _string(x, "$.text"))
        .when(_text(x, "$.type").isin("hide", "replace"), (_first(_anchor(x)).isNull()) & ((_text(x, "$.type") == "hide") | _string(x, "$.text"))),
        F.lit(False),
    )
    fits = lambda x: F.coalesce(F.length(_text(x, "$.text")) <= layout.cut_text, F.lit(True))
    return {
        "definitions": [*_item(v), ("meaning", _string(v, "$.meaning")), ("partOfSpeech", part), ("source", _string(v, "$.source", optional=True)), short("$.meaning", layout.meaning)],
        "annotations": [*_item(v), ("color", _string(v, "$.color")), ("notes", _string(v, "$.notes")), ("links", _each(v, "$.links", link)), ("citations", _each(v, "$.citations", cite)), short("$.notes", layout.text)],
        "cuts": [("id", _string(v, "$.id", 1)), ("versionId", _string(v, "$.versionId", 1)), ("name", F.coalesce(_trimmed(_text(v, "$.name")) != "", F.lit(False))), ("createdAt", _string(v, "$.createdAt")), ("updatedAt", _string(v, "$.updatedAt")), ("operations", _each(v, "$.operations", operation)), ("too long", _each(v, "$.operations", fits))],
    }


def _headed(v: Column, name: str, layout: Layout, entry: str) -> Column:
    """Why an entry is refused as a whole."""
    number = F.when(_is(_kind(v, "$.formatVersion"), "BIGINT") | _is(_kind(v, "$.formatVersion"), "D"), F.try_variant_get(v, "$.formatVersion", "double"))
    return (
        F.when(v.isNull(), f"{entry}: not valid JSON")
        .when(~F.coalesce(_text(v, "$.format") == name, F.lit(False)), "not a notes file")
        .when(number > layout.version, "made by a newer version")
        .when(~F.coalesce(number == layout.version, F.lit(False)), f"{entry}: incomplete at formatVersion")
    )


def read(files: DataFrame, layout: Layout = Layout()) -> tuple[DataFrame, DataFrame]:
    """``path``, ``refused``, ``play``, ``collection``, ``accepted``, ``rejected``, ``whole`` of archives, and their records.

    Records: ``path``, ``kind`` (``definitions``, ``annotations``, ``cuts``), ``n`` (from 0), ``reason`` (the first field that is wrong, or ``too
    long``; null where accepted), ``record`` (JSON).
    """
    told = opened(files, layout)
    rows = told.withColumn("n", F.try_parse_json("notes")).withColumn("c", F.try_parse_json("cuts"))
    n, c = F.col("n"), F.col("c")
    head = [
        ("exportedAt", _string(n, "$.exportedAt")), ("generator", _string(n, "$.generator.app") & _string(n, "$.generator.version")),
        ("collection.name", F.coalesce(_trimmed(_text(n, "$.collection.name")) != "", F.lit(False))), ("play.id", _string(n, "$.play.id", 1)),
        ("versions", _is(_kind(n, "$.versions"), "OBJECT") & F.forall(F.map_values(F.coalesce(F.try_variant_get(n, "$.versions", "map<string,variant>"), F.create_map().cast("map<string,variant>"))), lambda x: _string(x, "$.revision"))),
        *[(part, _items(n, f"$.{part}").isNotNull()) for part in ("definitions", "annotations")],
    ]
    wrong = lambda entry, checks: F.when(_first(checks).isNotNull(), F.concat(F.lit(f"{entry}: incomplete at "), _first(checks)))
    has_cuts = F.col("cuts").isNotNull()
    cut_head = [("play.id", _string(c, "$.play.id", 1)), ("cuts", _items(c, "$.cuts").isNotNull())]
    other = F.when(_text(c, "$.play.id") != _text(n, "$.play.id"), "cuts of another play")
    reason = F.coalesce("refused", _headed(n, layout.notes_format, layout, layout.notes), wrong(layout.notes, head), F.when(has_cuts, F.coalesce(_headed(c, layout.cuts_format, layout, layout.cuts), wrong(layout.cuts, cut_head), other)))
    rows = kept(rows.select("path", reason.alias("refused"), "notes", "cuts"))
    good = rows.where("refused is null").withColumn("n", F.try_parse_json("notes")).withColumn("c", F.try_parse_json("cuts"))
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), _items(v, f"$.{k}").alias("items")) for k, v in (("definitions", n), ("annotations", n), ("cuts", c))])
    dealt = good.select("path", F.inline(parts)).select("path", "kind", F.posexplode("items").alias("n", "v"))
    reason = F.lit(None).cast("string")
    for kind, checks in _checks(F.col("v"), layout).items():
        reason = F.when(F.col("kind") == kind, _first(checks)).otherwise(reason)
    records = kept(dealt.select("path", "kind", "n", reason.alias("reason"), F.to_json("v").alias("record")))
    counts = records.groupBy("path").agg(F.count_if(F.col("reason").isNull()).alias("accepted"), F.count("reason").alias("rejected"))
    named = good.select("path", _text(n, "$.play.id").alias("play"), _trimmed(_text(n, "$.collection.name")).alias("collection"))
    summary = rows.select("path", "refused").join(named, "path", "left").join(counts, "path", "left")
    zero = lambda k: F.coalesce(k, F.lit(0).cast("long")).alias(k)
    summary = summary.select("path", "refused", "play", "collection", zero("accepted"), zero("rejected"), (F.col("refused").isNull() & (F.coalesce("rejected", F.lit(0)) == 0)).alias("whole"))
    return summary, records


def _quoted(c: Column) -> Column:
    """A string as JSON; null is an empty one."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def written(collections: DataFrame, records: DataFrame, layout: Layout = Layout(), app: str = "quirework", app_version: str = "1") -> DataFrame:
    """``path``, ``content``: an archive for each of ``collections`` (``path``, ``play``, ``collection``, ``exported_at``, ``versions``, a map to revisions).

    ``records`` have ``path``, ``kind``, ``n`` (their order) and ``record`` (JSON). The same rows give the same bytes. A collection's archive is made
    in one task, as its size is bounded when it is read.
    """
    listed = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("n", "record")))), lambda r: r["record"]), ",")
    held = records.groupBy("path").agg(*[listed(k).alias(k) for k in ("definitions", "annotations", "cuts")])
    rows = collections.join(held, "path", "left")
    array = lambda k: F.concat(F.lit(f'"{k}":['), F.coalesce(k, F.lit("")), F.lit("]"))
    play = F.concat(F.lit('"play":{"id":'), _quoted(F.col("play")), F.lit("}"))
    header = lambda name: F.lit(f'{{"format":"{name}","formatVersion":{layout.version},')
    versions = F.concat(F.lit('"versions":'), F.to_json(F.transform_values("versions", lambda _, r: F.struct(r.alias("revision")))))
    made = F.concat(F.lit(f'"generator":{{"app":"{app}","version":"{app_version}"}},"exportedAt":'), _quoted(F.col("exported_at")), F.lit(',"collection":{"name":'), _quoted(F.col("collection")), F.lit("},"))
    notes = F.concat(header(layout.notes_format), made, play, F.lit(","), versions, F.lit(","), array("definitions"), F.lit(","), array("annotations"), F.lit("}"))
    cuts = F.when(F.coalesce("cuts", F.lit("")) != "", F.concat(header(layout.cuts_format), play, F.lit(","), array("cuts"), F.lit("}")))

    def of(path: str, *entries: str | None) -> tuple[str, bytes]:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, text in zip((layout.notes, layout.cuts), entries, strict=True):
                if text is not None:
                    archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)
        return path, out.getvalue()

    arrays.bounded(records.sparkSession)
    told = rows.select("path", notes.alias("n"), cuts.alias("c"))
    return told.mapInArrow(arrays.batched(of, pa.schema([("path", pa.string()), ("content", pa.binary())])), "path string, content binary")
