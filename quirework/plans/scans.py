"""Queries of scans over texts that the driver's tables give, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import order
from ..sources import archives, dictionaries, editions, markup


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = order.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return order.lines(docs)


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a dictionary: an entry with two senses for each of its lines of three words or more, over five printed lines."""
    words = F.regexp_extract_all("line", F.lit("[a-z]{2,}"), F.lit(0))
    rows = _lines(spark, sf_dir).select("doc_id", "n", words.alias("w")).where("size(w) >= 3")
    head = F.concat(F.lit("A"), F.translate(F.lpad(F.col("n").cast("string"), 5, "0"), "0123456789", "abcdefghij"))
    say = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    n = lambda k: (F.col("n") + k).cast("string")
    w = lambda k: F.col("w")[k]
    printed = F.array(
        say(head, ", subst., 1) to ", w(0), " thing: ", w(1), "-"),
        say(w(2), " Hml. III, 1, ", n(1), ". ", n(7), ". Tp. Il, ", n(2), "."),
        F.lit(""),
        say("2) an ", w(2), " other: Lr. 1, 2, ", n(3), ". Hence = to ", w(1), ": so ", w(0), ", Prol. 5, 6"),
        F.lit(""),
    )
    return rows.select(F.col("doc_id").alias("book"), "n", F.posexplode(printed).alias("k", "line")).select("book", (F.col("n") * 5 + F.col("k")).alias("n"), "line")


def dictionary_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = dictionaries.first_dictionary(_printed(spark, sf_dir))
    return told.select("book", "entry", "headword", "part_of_speech", "sense", "label", "gloss", F.posexplode("citations").alias("c", "cite")).select("book", "entry", "headword", "part_of_speech", "sense", "label", "gloss", "c", "cite.*")


def early_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a print without divisions: a speech for each line of three words or more, with gaps, italics, exits and page breaks."""
    words = F.regexp_extract_all("line", F.lit("[a-z]{2,}"), F.lit(0))
    rows = _lines(spark, sf_dir).select("doc_id", "n", words.alias("w")).where("size(w) >= 3")
    some = lambda k, what: F.when(F.col("n") % k == 0, what).otherwise("")
    say = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    w = lambda k: F.col("w")[k]
    speech = say(some(5, say('<pb n="', F.col("n").cast("string"), '"/>')), "<sp><speaker>", F.initcap(w(0)), ".</speaker><l>", w(0), some(7, "<gap/>"), " ", w(1), " <hi>", w(2), "</hi>", some(4, "<stage>Exit.</stage>"), "</l></sp>\n")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", speech.alias("x")))), lambda p: p["x"]), "")
    files = rows.groupBy("doc_id").agg(say('<TEI><text><body><div type="text">', body, "</div></body></text></TEI>").cast("binary").alias("content")).withColumn("path", F.col("doc_id").cast("string"))
    play = editions.early_play(markup.events(files))
    told = editions.early_nodes(play, editions.early_scenes(play))
    spans = F.array_join(F.transform("marks", lambda m: F.concat_ws(" ", m["start"], m["end"], m["type"])), ",")
    return told.select("path", "idx", "kind", "text", "form", "speech", "label", spans.alias("marks"), F.array_join(F.transform("pages", lambda p: F.concat_ws(" ", p["page"], p["offset"])), ",").alias("pages"))


def archived_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a collection of definitions, a line each, written to an archive and read back; some without id or place, long ones rejected."""
    lines = _lines(spark, sf_dir).withColumn("path", F.col("doc_id").cast("string"))
    end = lambda off: F.struct(F.concat(F.lit("l"), F.col("n").cast("string")).alias("nodeId"), off.alias("offset"))
    anchor = F.struct(end(F.lit(0)).alias("start"), end(F.when(F.col("n") % 7 == 5, -1).otherwise(F.length("line"))).alias("end"), F.struct(F.concat(F.lit("w"), "line").alias("exact"), F.lit("").alias("prefix"), F.lit("").alias("suffix")).alias("quote"), F.lit("r").alias("revision"))
    record = F.struct(F.when(F.col("n") % 10 == 9, "").otherwise(F.concat_ws("-", "path", "n")).alias("id"), F.lit("v").alias("versionId"), anchor.alias("anchor"), F.lit("").alias("createdAt"), F.lit("").alias("updatedAt"), F.col("line").alias("meaning"))
    records = lines.select("path", F.lit("definitions").alias("kind"), "n", F.to_json(record).alias("record"))
    collections = lines.select("path").distinct().select("path", F.lit("p").alias("play"), F.concat(F.lit("No. "), "path").alias("collection"), F.lit("").alias("exported_at"), F.create_map(F.lit("v"), F.lit("r")).alias("versions"))
    told, read = archives.read(archives.written(collections, records), archives.Layout(meaning=1_000))
    meaning = F.get_json_object("record", "$.meaning")
    return read.join(told.select("path", "collection", "whole"), "path").select("path", "collection", "whole", "n", "reason", F.length(meaning).alias("size"))


QUERIES = {f.__name__: f for f in (dictionary_citations, early_nodes, archived_notes)}

ORACLE = {
    "dictionary_citations": """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS n FROM documents),
        w AS (SELECT doc_id, n, regexp_extract_all(line, '[a-z]{2,}') AS w FROM l),
        e AS (SELECT doc_id AS book, row_number() OVER (PARTITION BY doc_id ORDER BY n)::INT AS entry, 'A' || translate(lpad(n::VARCHAR, 5, '0'), '0123456789', 'abcdefghij') AS headword, n, w FROM w WHERE len(w) >= 3)
        SELECT book, entry, headword, 'noun' AS part_of_speech, s AS sense, label, CASE s WHEN 0 THEN 'to ' || w[1] || ' thing' WHEN 1 THEN 'an ' || w[3] || ' other' ELSE 'to ' || w[2] END AS gloss, c, play, act, scene, part, (CASE WHEN s = 2 THEN k ELSE n + k END)::INT AS line,
        CASE WHEN s = 0 AND c = 0 THEN w[2] || w[3] WHEN s = 2 AND c = 0 THEN 'so ' || w[1] ELSE '' END AS quote
        FROM e, (VALUES (0, '1', 0, 'Hml', 3, 1, NULL, 1), (0, '1', 1, 'Hml', 3, 1, NULL, 7), (0, '1', 2, 'Tp', 2, NULL, NULL, 2), (1, '2', 0, 'Lr', 1, 2, NULL, 3)) v(s, label, c, play, act, scene, part, k)""",
    "early_nodes": """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS n FROM documents),
        w AS (SELECT doc_id, n, regexp_extract_all(line, '[a-z]{2,}') AS w FROM l),
        s AS (SELECT doc_id, n, w, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS speech, w[1] || CASE WHEN n % 7 = 0 THEN '•' ELSE '' END AS a FROM w WHERE len(w) >= 3),
        k AS (SELECT doc_id, n, 0 AS k, 'line' AS kind, a || ' ' || w[2] || ' ' || w[3] AS text, 'verse' AS form, speech, w, (CASE WHEN n % 7 = 0 THEN length(a) - 1 || ' ' || length(a) || ' gap,' ELSE '' END) || (length(a) + 2 + length(w[2])) || ' ' || (length(a) + 2 + length(w[2]) + length(w[3])) || ' italic' AS marks, CASE WHEN n % 5 = 0 THEN n || ' 0' ELSE '' END AS pages FROM s
            UNION ALL SELECT doc_id, n, 1, 'sd', 'Exit.', NULL, speech, w, '', '' FROM s WHERE n % 4 = 0)
        SELECT doc_id::VARCHAR AS path, (row_number() OVER (PARTITION BY doc_id ORDER BY n, k) - 1)::INT AS idx, kind, text, form, speech::INT AS speech, upper(w[1][1]) || w[1][2:] || '.' AS label, marks, pages FROM k""",
    "archived_notes": """WITH l AS (SELECT doc_id::VARCHAR AS path, unnest(string_split(coalesce(text, ''), chr(10))) AS line, (generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1)::INT AS n FROM documents),
        r AS (SELECT *, CASE WHEN n % 10 = 9 THEN 'id' WHEN n % 7 = 5 THEN 'anchor.end' WHEN length(line) > 1000 THEN 'too long' END AS reason FROM l)
        SELECT path, 'No. ' || path AS collection, count(reason) OVER (PARTITION BY path) = 0 AS whole, n, reason, length(line)::INT AS size FROM r""",
}
