"""Queries of anchors, overlays and alignments over the driver's tables, and their SQL. A document's lines are its nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.kept import kept
from ..operators import anchors, cuts, order, sequences
from .queries import QUERIES as LIBRARY


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def _nodes(docs: DataFrame) -> DataFrame:
    return order.lines(docs).select("doc_id", F.col("n").alias("idx"), F.col("line").alias("text"))


def _anchors(docs: DataFrame) -> DataFrame:
    """Two spans a document: within its first line, and over two lines."""
    spans = ((0, 0, 4, 0, 24), (1, 0, 10, 1, 12))
    made = F.array(*[F.struct((F.col("doc_id") * 2 + k).alias("id"), *[F.lit(x).alias(p) for x, p in zip(at, anchors.PLACE, strict=True)]) for k, *at in spans])
    return docs.select("doc_id", F.inline(made))


def anchor_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return anchors.pieces(_anchors(docs), _nodes(docs), "doc_id").select("id", "idx", "start", "end")


def anchor_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return anchors.quotes(_anchors(docs), _nodes(docs), "doc_id")


def snapped_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return anchors.snapped(_anchors(docs), _nodes(docs), "doc_id")


def _ops(docs: DataFrame) -> DataFrame:
    """An overlay a document: hides lines 1 and 2 up to character 5, replaces a part of line 3, adds two lines behind line 1."""
    op = lambda k, kind, at, after, n, text: F.struct((F.col("doc_id") * 4 + k).alias("id"), F.lit(kind).alias("type"), *[F.lit(x).cast("int").alias(p) for x, p in zip(at, anchors.PLACE, strict=True)], F.lit(after).cast("int").alias("after"), F.lit(n).cast("int").alias("n"), F.lit(text).cast("string").alias("insert_text"))
    none = (None,) * 4
    made = F.array(op(0, "hide", (1, 0, 2, 5), None, None, None), op(1, "replace", (3, 0, 3, 9), None, None, "They"), op(2, "insert", none, 1, 2, "Exeunt."), op(3, "insert", none, 1, 1, "Exit."))
    return docs.select("doc_id", F.inline(made))


def cut_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return cuts.displayed(_ops(docs), _nodes(docs), "doc_id")


def cut_landings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return cuts.landing(cuts.displayed(_ops(docs), _nodes(docs), "doc_id"), _nodes(docs), "doc_id")


def cut_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of two lines of which both are hidden."""
    docs = _documents(spark, sf_dir)
    nodes = _nodes(docs).withColumn("scene", F.floor((F.col("idx") + 1) / 2).cast("int"))
    return cuts.hidden_groups(cuts.hidden_nodes(_ops(docs), nodes, "doc_id"), nodes, "doc_id", "scene")


def replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of five replacements the overlay allows: before, touching, within and after its hide, and over its replacement."""
    docs = _documents(spark, sf_dir).select("doc_id")
    spans = ((0, 0, 3, 0, 9), (1, 0, 3, 1, 0), (2, 1, 2, 1, 4), (3, 2, 5, 3, 0), (4, 2, 8, 3, 1))
    made = F.array(*[F.struct((F.col("doc_id") * 5 + k).alias("id"), *[F.lit(x).alias(p) for x, p in zip(at, anchors.PLACE, strict=True)]) for k, *at in spans])
    return cuts.replaceable(docs.select("doc_id", F.inline(made)), _ops(docs), "doc_id").select("id")


def reworded_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = _ops(_documents(spark, sf_dir).select("doc_id"))
    return cuts.reworded(ops, ops.where("id % 3 = 0").select("id", F.lit("Anew.").alias("text"))).select("id", "type", "insert_text")


def node_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marks of two terms on each anchor."""
    docs = _documents(spark, sf_dir)
    one = _anchors(docs)
    marks = cuts.decorations(one.unionByName(one.withColumn("id", -F.col("id") - 1)), _nodes(docs), "doc_id")
    return marks.select("doc_id", "idx", "start", "end", F.array_join(F.transform("terms", lambda t: t.cast("string")), ",").alias("terms"))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document held against those of each benchmark item of which it holds five words or more."""
    docs, items = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    pairs = kept(LIBRARY["landmarks"](spark, sf_dir).select("doc_id", "item_id"))
    side = lambda rows, key, name: pairs.join(order.lines(rows, key), key).select("doc_id", "item_id", F.lit(name).alias("side"), "n", F.lit("line").alias("kind"), tx.keys(F.col("line")).alias("keys"))
    return sequences.align_blocks(side(items, "item_id", "orig").unionByName(side(docs, "doc_id", "modern")), ["doc_id", "item_id"])


QUERIES = {f.__name__: f for f in (anchor_pieces, anchor_quotes, snapped_spans, cut_display, cut_landings, cut_scenes, replacements, reworded_ops, node_marks, alignments)}

_NODES = "d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), n AS (SELECT doc_id, l, unnest(l) AS text, (generate_subscripts(l, 1) - 1)::INT AS idx FROM d)"
_SPANS = "a AS (SELECT doc_id, doc_id * 2 + k AS id, k, l, l[1] AS x, CASE WHEN k = 0 THEN l[1] ELSE l[2] END AS y, CASE WHEN k = 0 THEN 4 ELSE 10 END AS so, k::INT AS ei, CASE WHEN k = 0 THEN 24 ELSE 12 END AS eo FROM d, (VALUES (0), (1)) v(k))"
_QUOTED = "q AS (SELECT *, CASE WHEN k = 0 THEN substr(x, 5, 20) ELSE substr(x, 11) || chr(10) || substr(y, 1, 12) END AS exact, substr(x, 1, so) AS prefix, substr(y, eo + 1, 32) AS suffix FROM a WHERE y IS NOT NULL)"
_PIECES = "p AS (SELECT id, 0 AS idx, so AS s, least(CASE WHEN k = 0 THEN eo ELSE length(x) END, length(x)) AS e FROM a UNION ALL SELECT id, 1, 0, least(eo, length(y)) FROM a WHERE k = 1 AND y IS NOT NULL)"
_WORD, _TRIM = r"[\p{L}\p{N}''’-]", r"[\s\p{P}]"
#: Nodes that the overlay hides whole: line 1 if it has text, line 2 if it has one to five characters.
_HIDDEN = f"{_NODES}, h AS (SELECT doc_id, idx FROM n WHERE (idx = 1 AND text <> '') OR (idx = 2 AND length(text) BETWEEN 1 AND 5))"
_SHOWN = "s AS (SELECT doc_id, idx, 0 AS turn, text, NULL::VARCHAR AS op FROM n ANTI JOIN h USING (doc_id, idx) UNION ALL SELECT doc_id, 1, t, x, (doc_id * 4 + 4 - t)::VARCHAR FROM n, (VALUES (1, 'Exit.'), (2, 'Exeunt.')) v(t, x) WHERE idx = 1)"
ORACLE = {
    "anchor_pieces": f"WITH {_NODES}, {_SPANS}, {_PIECES} SELECT id, idx, s AS start, e::INT AS \"end\" FROM p WHERE s < e",
    "anchor_quotes": f"WITH {_NODES}, {_SPANS}, {_QUOTED} SELECT id, exact, prefix, suffix FROM q",
    "snapped_spans": f"""WITH {_NODES}, {_SPANS}, w AS (SELECT id, k, x, y,
        CASE WHEN regexp_matches(substr(x, so + 1, 1), '{_WORD}') THEN so - length(regexp_extract(substr(x, 1, so), '({_WORD}*)$', 1)) ELSE so END AS so,
        CASE WHEN regexp_matches(substr(y, eo, 1), '{_WORD}') THEN eo + length(regexp_extract(substr(y, eo + 1), '^({_WORD}*)', 1)) ELSE eo END AS eo FROM a WHERE y IS NOT NULL),
        p AS (SELECT id, 0 AS idx, so AS s, substr(x, so + 1, CASE WHEN k = 0 THEN eo - so ELSE length(x) END) AS t FROM w UNION ALL SELECT id, 1, 0, substr(y, 1, eo) FROM w WHERE k = 1),
        r AS (SELECT id, idx, s + length(regexp_extract(t, '^({_TRIM}*)', 1)) AS b, s + length(t) - length(regexp_extract(t, '({_TRIM}*)$', 1)) AS e FROM p WHERE regexp_matches(t, '[^{_TRIM[1:]}'))
        SELECT id, min(idx)::INT AS start_idx, arg_min(b, idx)::INT AS start_off, max(idx)::INT AS end_idx, arg_max(e, idx)::INT AS end_off FROM r GROUP BY id""",
    "cut_display": f"WITH {_HIDDEN}, {_SHOWN} SELECT * FROM s",
    "cut_landings": f"""WITH {_HIDDEN}, o AS (SELECT n.doc_id, n.idx, CASE WHEN h.idx IS NULL THEN n.idx END AS own FROM n LEFT JOIN h ON n.doc_id = h.doc_id AND n.idx = h.idx)
        SELECT doc_id, idx, coalesce(min(own) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), max(own) OVER (PARTITION BY doc_id)) AS lands FROM o""",
    "cut_scenes": f"WITH {_HIDDEN}, m AS (SELECT n.doc_id, floor((n.idx + 1) / 2)::INT AS scene, h.idx IS NOT NULL AS hid FROM n LEFT JOIN h ON n.doc_id = h.doc_id AND n.idx = h.idx) SELECT doc_id, scene FROM m GROUP BY ALL HAVING bool_and(hid)",
    "replacements": "SELECT doc_id * 5 + k AS id FROM documents, (VALUES (0), (1), (3)) v(k)",
    "reworded_ops": """SELECT doc_id * 4 + k AS id, t AS type, CASE WHEN k > 0 AND (doc_id * 4 + k) % 3 = 0 THEN 'Anew.' ELSE x END AS insert_text
        FROM documents, (VALUES (0, 'hide', NULL), (1, 'replace', 'They'), (2, 'insert', 'Exeunt.'), (3, 'insert', 'Exit.')) v(k, t, x)""",
    "node_marks": f"WITH {_NODES}, {_SPANS}, {_PIECES} SELECT id // 2 AS doc_id, idx, s AS start, e::INT AS \"end\", (-id - 1) || ',' || id AS terms FROM p WHERE s < e",
}
