"""Queries of moved anchors, compared versions and divisions over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.kept import kept
from ..operators import aligned, anchors, compare, divisions, order, refind, variants
from .queries import _KEYS, _grams


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as texts, their lines as nodes, with the place at which each begins in its text."""
    docs = order.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    lines = order.lines(docs).select("doc_id", F.col("n").alias("idx"), F.col("line").alias("text"))
    return kept(order.running_offset(lines, ["doc_id"], "idx", F.length("text") + 1, "begin"))


def _kind(doc: Column, idx: Column) -> Column:
    return (doc + idx) % 7


def _stored(nodes: DataFrame) -> DataFrame:
    """Anchors on every third line, of seven kinds: unchanged, shifted, in another line, short, short without surroundings, reworded, over two lines."""
    kind = _kind(F.col("doc_id"), F.col("idx"))
    begin = (F.col("doc_id") * 7 + F.col("idx") * 3) % 11
    size = F.when(kind.isin(3, 4), 2 + F.col("idx") % 3).otherwise(12 + F.col("idx") % 20)
    over = F.when(kind == 6, 1).otherwise(0)
    made = nodes.where("idx % 3 = 1").select(
        (F.col("doc_id") * 100_000 + F.col("idx")).alias("id"), "doc_id",
        F.col("idx").alias("start_idx"), begin.cast("int").alias("start_off"),
        (F.col("idx") + over).alias("end_idx"), F.when(kind == 6, size % 9).otherwise(begin + size).cast("int").alias("end_off"), kind.alias("kind"),
    )
    quoted = made.join(anchors.quotes(made, nodes, "doc_id"), "id")
    shift = F.when(F.col("kind").isin(1, 3, 4, 6), 3).otherwise(0)
    away = F.when(F.col("kind") == 2, 1).otherwise(0)
    return quoted.select(
        "id", "doc_id", *[(F.col(f"{p}_idx") + away).alias(f"{p}_idx") for p in ("start", "end")], *[(F.col(f"{p}_off") + shift).alias(f"{p}_off") for p in ("start", "end")],
        F.when(F.col("kind") == 5, F.concat("exact", F.lit("#"))).otherwise(F.col("exact")).alias("exact"),
        *[F.when(F.col("kind") == 4, "").otherwise(F.col(c)).alias(c) for c in ("prefix", "suffix")],
    )


def refound_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    return refind.resolved(_stored(nodes), nodes, "doc_id")


def text_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line and offset of every 97th character of each document."""
    nodes = _nodes(spark, sf_dir)
    whole = nodes.groupBy("doc_id").agg(F.max(F.col("begin") + F.length("text")).alias("end"))
    points = whole.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("end").cast("long"), F.lit(97).cast("long"))).alias("at")).withColumn("point", F.col("at"))
    return refind.positions(points, nodes, "doc_id")


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Each document as two versions: its lines, and its lines begun a third further on; with entries of two and of three lines, some left out, some that reach to a later line."""
    left = _nodes(spark, sf_dir).select("doc_id", "idx", "text")
    size = left.groupBy("doc_id").agg(F.count("*").cast("int").alias("size"))
    third = F.floor(F.col("size") / 3).cast("int")
    right = left.join(size, "doc_id").select("doc_id", ((F.col("idx") - third + F.col("size")) % F.col("size")).alias("idx"), "text")
    held = lambda n: F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.col("entry") * n + i).cast("int")), lambda x: x < F.col("size"))
    entries = lambda n: size.select("doc_id", "size", third.alias("third"), F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / n).cast("int"))).alias("entry")).withColumn("orig", held(n))
    far = F.when(F.col("entry") % 4 == 1, F.array((F.col("entry") * 2 + 5).cast("int"))).otherwise(F.array().cast("array<int>"))
    mine = entries(2).where("entry % 5 <> 4").select("doc_id", "entry", "orig", F.concat("orig", far).alias("modern"))
    theirs = entries(3).where("entry % 4 <> 2").select("doc_id", "entry", "orig", F.transform("orig", lambda x: (x + F.col("third")) % F.col("size")).alias("modern"))
    return left, right, mine, theirs


def compared_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right, *entries = _versions(spark, sf_dir)
    found = compare.rows(left, right, "doc_id", *entries)
    return found.select("doc_id", "place", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("left", "right")], "moved")


def word_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right, *entries = _versions(spark, sf_dir)
    return compare.differences(compare.rows(left, right, "doc_id", *entries), left, right, "doc_id")


def word_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.word_spans(_nodes(spark, sf_dir), "doc_id").select("doc_id", "idx", "start", "end", "word")


def node_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts that 90 of every 150 characters of each document have in its lines."""
    nodes = _nodes(spark, sf_dir)
    whole = nodes.groupBy("doc_id").agg(F.max(F.col("begin") + F.length("text")).cast("int").alias("size"))
    ranges = whole.select("doc_id", F.explode(F.sequence(F.lit(0), "size", F.lit(150))).alias("start")).select("doc_id", "start", (F.col("start") + 90).alias("end"))
    return compare.by_node(ranges, nodes, "doc_id")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks of their document, every fourth an entrance, and in which of four quarters of it they are."""
    docs = order.together(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("doc_id is not null"), "doc_id")
    lines = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("l")).select("doc_id", F.size("l").alias("size"), F.posexplode("l").alias("n", "line"))
    return lines.select("doc_id", "n", tx.keys(F.col("line")).alias("words"), (F.col("n") % 4 == 0).alias("entrance"), F.floor(F.col("n") * 4 / F.col("size")).cast("int").alias("quarter"))


def _scenes(blocks: DataFrame, backward: bool = False) -> DataFrame:
    """The quarters without every fifth line, in order or backward, as scenes."""
    listed = F.array_sort(F.collect_list(F.when(F.col("n") % 5 != 3, F.struct("n", "words"))))
    at = F.lit(3) - F.col("quarter") if backward else F.col("quarter")
    return blocks.groupBy("doc_id", at.alias("n")).agg(F.flatten(F.transform(listed, lambda r: r["words"])).alias("words"))


def scene_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one printed scene, cut where its quarters begin."""
    blocks = _blocks(spark, sf_dir)
    scenes = _scenes(blocks).withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("n")) - 1)
    return divisions.split(blocks, scenes, ["doc_id"])


def scene_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    return divisions.labels(blocks, _scenes(blocks, backward=True), ["doc_id"])


def reordered_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    return divisions.reordered(blocks, _scenes(blocks, backward=True), ["doc_id"])


def _marked(nodes: DataFrame) -> DataFrame:
    """Passages of an edition: three tokens of every fifth line, the second in a line up to two further on, the third in no line."""
    p = F.col("idx")
    says = F.when(p % 3 == 0, "lines not found in the second quarto").when(p % 3 == 1, "Text not found in the Folio").otherwise("editorial emendation")
    token = lambda turn, idx, start, end: F.struct(F.lit(turn).alias("turn"), idx.cast("int").alias("idx"), F.lit(start).alias("start"), F.lit(end).alias("end"))
    made = F.array(token(0, p, 2, 6), token(1, p + (p / 5).cast("int") % 3, 0, 7), token(2, F.lit(None), None, None))
    tokens = nodes.where("idx % 5 = 0").select("doc_id", p.alias("passage"), says.alias("description"), F.inline(made))
    there = nodes.select("doc_id", "idx")
    return tokens.join(there.withColumn("there", F.lit(True)), ["doc_id", "idx"], "left").withColumn("idx", F.when(F.col("there"), F.col("idx"))).drop("there")


def _printings(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two printings of each document, one with every third line aligned to itself and the next, one scattered, and their alignments."""
    size = F.count("*").over(Window.partitionBy("doc_id"))
    sized = nodes.withColumn("size", size)
    lines = sized.select("doc_id", F.explode(F.array(F.lit("q1-1600"), F.lit("f1-1623"))).alias("version"), "idx", F.concat(F.lit(">"), "text").alias("text"))
    quarto = sized.where("idx % 3 = 0").select("doc_id", F.lit("q1-1600").alias("version"), F.col("idx").alias("entry"), F.array("idx").alias("orig"), F.array(F.col("idx"), F.col("idx") + 1).alias("modern"))
    folio = sized.where("idx % 4 <> 3").select("doc_id", F.lit("f1-1623").alias("version"), F.col("idx").alias("entry"), F.array((F.col("idx") * 5 % F.col("size")).cast("int")).alias("orig"), F.array("idx").alias("modern"))
    return lines, quarto.unionByName(folio)


def seeded_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir).select("doc_id", "idx", "text", F.when(F.col("idx") % 2 == 1, F.concat(F.lit("1.1."), F.col("idx").cast("string"))).alias("number"))
    found = kept(variants.passages(_marked(nodes), nodes, "doc_id"))
    read = variants.seeded(found, *_printings(nodes), "doc_id")
    titles = found.select("doc_id", "passage", variants.title(F.col("description"), F.col("text"), F.col("number")).alias("title"))
    return read.join(titles, ["doc_id", "passage"]).select("doc_id", "passage", "title", "version", "start_idx", "end_idx", "end_off", "text")


def aligned_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document in four scenes against itself without every fifth line and with the later scenes first."""
    blocks = _blocks(spark, sf_dir)
    rows = blocks.select("doc_id", "quarter", F.col("n").alias("idx"), F.lit("line").alias("kind"), F.col("words").alias("keys"))
    modern = rows.withColumnRenamed("quarter", "turn")
    turned = rows.where("idx % 5 <> 3").withColumn("turn", (F.col("quarter") + 2) % 4)
    orig = turned.withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("turn", "idx")) - 1).drop("quarter")
    scenes = lambda rows, no: rows.select("doc_id", "turn").distinct().select("doc_id", "turn", F.lit(1).alias("act"), F.lit("scene").alias("kind"), no.cast("int").alias("no"))
    return aligned.versions(orig, modern, scenes(orig, (F.col("turn") + 2) % 4), scenes(modern, F.col("turn")), "doc_id")


def applied_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, _, mine, _ = _versions(spark, sf_dir)
    modern = left.select("doc_id", "idx", F.lit("line").alias("kind"), F.when(F.col("idx") % 3 != 1, F.concat(F.lit("1."), F.col("idx").cast("string"))).alias("number"))
    orig = left.select("doc_id", "idx", F.when(F.col("idx") % 7 == 6, "sd").otherwise("line").alias("kind"))
    return aligned.numbers(orig, modern, mine, "doc_id")


def label_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as speeches under four labels, some without, spoken by whom the first letters of their counterparts name."""
    left, _, mine, _ = _versions(spark, sf_dir)
    label = F.when(F.col("idx") % 7 == 6, "").otherwise(F.concat(F.lit("S"), F.translate((F.col("idx") % 4).cast("string"), "0123", "abcd"), F.lit(".")))
    speeches = left.select("doc_id", F.col("idx").alias("speech"), label.alias("label"), "idx")
    first = F.regexp_extract(F.lower("text"), "[a-z]", 0)
    voices = left.select("doc_id", "idx", F.when(first != "", F.array(first)).otherwise(F.array().cast("array<string>")).alias("speakers"))
    told = aligned.speakers(speeches, voices, mine, "doc_id")
    return told.select("doc_id", "speech", F.array_join("speakers", " ").alias("speakers"))


QUERIES = {f.__name__: f for f in (refound_anchors, text_positions, compared_rows, word_differences, word_places, node_ranges, scene_pieces, scene_labels, reordered_scenes, seeded_variants, aligned_versions, applied_numbers, label_speakers)}

_NODES = "d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), n AS (SELECT doc_id, l, text AS whole, unnest(l) AS text, (generate_subscripts(l, 1) - 1)::INT AS idx FROM d), f AS (SELECT *, (coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS b FROM n)"
_QUARTERS = f"{_NODES}, z AS (SELECT doc_id, idx, text, floor(idx * 4 / len(l))::INT AS quarter FROM f)"
_COUNTED = f"c AS (WITH t AS (SELECT doc_id * 100000 + idx AS id, text FROM z), {_KEYS} SELECT id, count(*) AS m FROM keys GROUP BY id), b AS (SELECT doc_id, idx, coalesce(m, 0) AS m, (coalesce(sum(coalesce(m, 0)) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS st FROM z LEFT JOIN c ON id = doc_id * 100000 + idx)"
_NEXT = lambda k: f"e{k} AS (SELECT e.doc_id, arg_min(b.idx, (abs(st - pr) + CASE WHEN b.idx % 4 = 0 THEN 0 ELSE 40 END, b.idx)) AS at FROM e{k - 1} e JOIN pr USING (doc_id) JOIN b ON b.doc_id = e.doc_id AND b.idx > e.at WHERE pr.k = {k} GROUP BY e.doc_id)"
_MINE = "z AS (SELECT doc_id, idx, text, len(l) AS c FROM f), e AS (SELECT doc_id, idx // 2 AS e, idx, c FROM z WHERE idx // 2 % 5 <> 4), m AS (SELECT doc_id, e, idx AS m, idx % 2 AS i FROM e UNION ALL SELECT DISTINCT doc_id, e, e * 2 + 5, 2 FROM e WHERE e % 4 = 1 AND e * 2 + 5 < c)"
ORACLE = {
    "applied_numbers": f"""WITH {_NODES}, {_MINE},
        o AS (SELECT doc_id, e, idx, row_number() OVER (PARTITION BY doc_id, e ORDER BY idx) AS i, count(*) OVER (PARTITION BY doc_id, e) AS k FROM e WHERE idx % 7 <> 6),
        gn AS (SELECT doc_id, e, '1.' || m AS number, row_number() OVER (PARTITION BY doc_id, e ORDER BY i) AS i, count(*) OVER (PARTITION BY doc_id, e) AS k FROM m WHERE m % 3 <> 1),
        p AS (SELECT o.doc_id, o.e, o.i, idx, number FROM o JOIN gn ON o.doc_id = gn.doc_id AND o.e = gn.e AND o.i = gn.i WHERE o.k = gn.k OR o.i = 1)
        SELECT doc_id, arg_min(idx, (e, i))::INT AS idx, number FROM p GROUP BY doc_id, number""",
    "label_speakers": f"""WITH {_NODES}, {_MINE},
        s AS (SELECT doc_id, idx, CASE WHEN idx % 7 = 6 THEN '#' || idx ELSE 's' || translate((idx % 4)::VARCHAR, '0123', 'abcd') END AS asks FROM z),
        v AS (SELECT s.doc_id, asks, regexp_extract(lower(z.text), '[a-z]') AS who FROM s JOIN e ON s.doc_id = e.doc_id AND s.idx = e.idx JOIN m ON m.doc_id = e.doc_id AND m.e = e.e JOIN z ON z.doc_id = m.doc_id AND z.idx = m.m),
        w AS (SELECT doc_id, asks, who, count(*) AS n FROM v WHERE who <> '' GROUP BY ALL),
        b AS (SELECT doc_id, asks, arg_min(who, (-n, who)) AS who FROM w GROUP BY ALL)
        SELECT s.doc_id, s.idx AS speech, coalesce(who, '') AS speakers FROM s LEFT JOIN b ON s.doc_id = b.doc_id AND s.asks = b.asks""",
    "scene_pieces": f"""WITH {_QUARTERS}, {_COUNTED},
        q AS (SELECT doc_id, quarter, row_number() OVER (PARTITION BY doc_id ORDER BY quarter) - 1 AS k FROM (SELECT DISTINCT doc_id, quarter FROM z)),
        ms AS (SELECT z.doc_id, k, sum(CASE WHEN z.idx % 5 <> 3 THEN m ELSE 0 END) AS m FROM z JOIN q USING (doc_id, quarter) JOIN b ON b.doc_id = z.doc_id AND b.idx = z.idx GROUP BY ALL),
        ps AS (SELECT doc_id, k, (coalesce(sum(m) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS pos FROM ms),
        o AS (SELECT id, gram, min(pos) AS o FROM {_grams(5, "doc_id AS id, text FROM documents")} GROUP BY ALL HAVING count(*) = 1),
        m AS (SELECT id, gram, min(pos) AS m FROM {_grams(5, "doc_id AS id, string_agg(text, chr(10) ORDER BY idx) AS text FROM z WHERE idx % 5 <> 3 GROUP BY doc_id")} GROUP BY ALL HAVING count(*) = 1),
        ch AS (SELECT id AS doc_id, o, m FROM o JOIN m USING (id, gram)),
        nb AS (SELECT ps.doc_id, k, pos, coalesce(arg_max(o, m) FILTER (m <= pos), 0) AS bo, coalesce(max(m) FILTER (m <= pos), 0) AS bm, arg_min(o, m) FILTER (m > pos) AS ao, min(m) FILTER (m > pos) AS am FROM ps LEFT JOIN ch ON ps.doc_id = ch.doc_id WHERE k > 0 GROUP BY ALL),
        pr AS (SELECT doc_id, k, CASE WHEN am IS NULL THEN bo + pos - bm ELSE floor(bo + (pos - bm)::DOUBLE / (am - bm) * (ao - bo) + 0.5) END AS pr FROM nb),
        e0 AS (SELECT doc_id, 0 AS at FROM d), {_NEXT(1)}, {_NEXT(2)}, {_NEXT(3)}
        SELECT b.doc_id, b.idx AS n, (coalesce((b.idx >= e1.at)::INT, 0) + coalesce((b.idx >= e2.at)::INT, 0) + coalesce((b.idx >= e3.at)::INT, 0))::INT AS piece FROM b LEFT JOIN e1 ON b.doc_id = e1.doc_id LEFT JOIN e2 ON b.doc_id = e2.doc_id LEFT JOIN e3 ON b.doc_id = e3.doc_id""",
    "scene_labels": f"""WITH {_QUARTERS}, {_COUNTED},
        g AS (SELECT DISTINCT id // 10 AS doc_id, id % 10 AS k, gram FROM {_grams(3, "doc_id * 10 + 3 - quarter AS id, string_agg(text, chr(10) ORDER BY idx) AS text FROM z WHERE idx % 5 <> 3 GROUP BY doc_id, quarter")}),
        w AS (SELECT doc_id, gram, round(1099511627776 / count(*))::BIGINT AS w FROM g GROUP BY ALL),
        p AS (SELECT id AS doc_id, pos, k, w FROM {_grams(3, "doc_id AS id, text FROM documents")} o JOIN g ON g.doc_id = o.id AND g.gram = o.gram JOIN w ON w.doc_id = o.id AND w.gram = o.gram),
        s AS (SELECT b.doc_id, b.idx, k, sum(w) AS s FROM b JOIN p ON b.doc_id = p.doc_id AND pos BETWEEN greatest(st - 60, 0) AND st + m + 57 GROUP BY ALL)
        SELECT b.doc_id, b.idx AS n, arg_max(k, (s, -k))::INT AS label FROM b LEFT JOIN s ON b.doc_id = s.doc_id AND b.idx = s.idx GROUP BY ALL""",
    "refound_anchors": f"""WITH {_NODES},
        m AS (SELECT doc_id * 100000 + idx AS id, doc_id, whole, idx, l, text AS x, ((doc_id + idx) % 7)::INT AS k, ((doc_id * 7 + idx * 3) % 11)::INT AS o, CASE WHEN (doc_id + idx) % 7 IN (3, 4) THEN 2 + idx % 3 ELSE 12 + idx % 20 END AS w FROM f WHERE idx % 3 = 1),
        q AS (SELECT *, CASE WHEN k = 6 THEN l[idx + 2] ELSE x END AS y, CASE WHEN k = 6 THEN w % 9 ELSE o + w END AS e FROM m),
        s AS (SELECT id, doc_id, whole, (idx + CASE WHEN k = 2 THEN 1 ELSE 0 END)::INT AS start_idx, (o + CASE WHEN k IN (1, 3, 4, 6) THEN 3 ELSE 0 END)::INT AS start_off, (idx + CASE WHEN k IN (2, 6) THEN 1 ELSE 0 END)::INT AS end_idx, (e + CASE WHEN k IN (1, 3, 4, 6) THEN 3 ELSE 0 END)::INT AS end_off, l,
            CASE WHEN k = 6 THEN substr(x, o + 1) || chr(10) || substr(y, 1, e) ELSE substr(x, o + 1, w) END || CASE WHEN k = 5 THEN '#' ELSE '' END AS exact,
            CASE WHEN k = 4 THEN '' ELSE substr(x, 1, o) END AS prefix, CASE WHEN k = 4 THEN '' ELSE substr(y, e + 1, 32) END AS suffix FROM q WHERE y IS NOT NULL),
        v AS (SELECT *, CASE WHEN end_idx < len(l) AND start_idx < len(l) THEN coalesce(CASE WHEN start_idx = end_idx THEN substr(l[start_idx + 1], start_off + 1, end_off - start_off) ELSE substr(l[start_idx + 1], start_off + 1) || chr(10) || substr(l[end_idx + 1], 1, end_off) END = exact, false) ELSE false END AS valid FROM s),
        lost AS (SELECT * FROM v WHERE NOT valid AND replace(exact, chr(10), '') <> ''),
        ch AS (SELECT doc_id, string_split(text, '') AS cs FROM d SEMI JOIN lost USING (doc_id)),
        ab AS (SELECT doc_id, unnest(cs) AS a1, unnest(list_concat(cs[2:], [''])) AS a2, generate_subscripts(cs, 1) AS p FROM ch),
        c AS (SELECT lost.*, p FROM lost JOIN ab ON lost.doc_id = ab.doc_id AND left(exact, 1) = a1 WHERE (length(exact) = 1 OR substr(exact, 2, 1) = a2) AND substr(whole, p, length(exact)) = exact),
        r AS (SELECT id, doc_id, exact, p, list_sum(list_transform(range(1, 1 + least(length(prefix), p - 1)), lambda i: (right(prefix, i) = substr(whole, p - i, i))::INT)) AS a, list_sum(list_transform(range(1, 1 + least(length(suffix), length(whole) - p - length(exact) + 1)), lambda i: (left(suffix, i) = substr(whole, p + length(exact), i))::INT)) AS z FROM c),
        g AS (SELECT id, doc_id, coalesce(a, 0) + coalesce(z, 0) AS agree, count(*) AS m, min(p) AS p, any_value(length(exact)) AS w FROM r GROUP BY ALL),
        b AS (SELECT id, doc_id, arg_max(p, agree) AS p, arg_max(m, agree) AS m, any_value(w) AS w FROM g GROUP BY ALL),
        u AS (SELECT b.id, f.idx AS start_idx, (p - 1 - f.b)::INT AS start_off, h.idx AS end_idx, (p - 1 + w - h.b)::INT AS end_off FROM b JOIN f ON f.doc_id = b.doc_id AND p - 1 BETWEEN f.b AND f.b + length(f.text) JOIN f h ON h.doc_id = b.doc_id AND p - 1 + w BETWEEN h.b AND h.b + length(h.text) WHERE m = 1)
        SELECT id, doc_id, 'valid' AS status, start_idx, start_off, end_idx, end_off FROM v WHERE valid
        UNION ALL SELECT v.id, doc_id, CASE WHEN u.id IS NULL THEN 'unattached' ELSE 'repaired' END, u.start_idx, u.start_off, u.end_idx, u.end_off FROM v LEFT JOIN u ON v.id = u.id WHERE NOT valid""",
    "text_positions": f"WITH {_NODES}, p AS (SELECT doc_id, unnest(range(0, length(text) + 1, 97)) AS pt FROM d) SELECT pt AS point, p.doc_id, f.idx, (pt - b)::INT AS off FROM p JOIN f ON p.doc_id = f.doc_id AND pt BETWEEN b AND b + length(text)",
    "compared_rows": f"""WITH {_NODES}, z AS (SELECT doc_id, idx, len(l) AS c, len(l) // 3 AS t FROM f),
        lu AS (SELECT doc_id, CASE WHEN idx // 2 % 5 = 4 THEN idx ELSE idx // 2 * 2 END AS u, idx, c FROM z),
        lm AS (SELECT DISTINCT doc_id, u, unnest(list_concat([u], CASE WHEN u + 1 < c THEN [u + 1] ELSE [] END, CASE WHEN u // 2 % 4 = 1 THEN [u + 5] ELSE [] END)) AS m FROM lu WHERE u // 2 % 5 <> 4),
        rm AS (SELECT doc_id, idx AS r, (unnest(range(idx // 3 * 3, least(idx // 3 * 3 + 3, c))) + t) % c AS m FROM z WHERE idx // 3 % 4 <> 2),
        cl AS (SELECT doc_id, r, min(u) AS u FROM rm JOIN lm USING (doc_id, m) GROUP BY ALL),
        rr AS (SELECT z.doc_id, idx AS r, u, coalesce(last_value(u IGNORE NULLS) OVER (PARTITION BY z.doc_id ORDER BY idx), -1) AS after FROM z LEFT JOIN cl ON z.doc_id = cl.doc_id AND idx = r),
        fr AS (SELECT doc_id, after, r, r - row_number() OVER (PARTITION BY doc_id, after ORDER BY r) AS run FROM rr WHERE u IS NULL),
        ly AS (SELECT doc_id, u AS row, -1 AS seq, list(idx ORDER BY idx) AS lf, (SELECT list(r ORDER BY r) FROM rr WHERE rr.doc_id = lu.doc_id AND rr.u = lu.u) AS rt FROM lu GROUP BY doc_id, u UNION ALL SELECT doc_id, after, min(r), [], list(r ORDER BY r) FROM fr GROUP BY doc_id, after, run)
        SELECT doc_id, (row_number() OVER w)::INT AS place, array_to_string(lf, ',') AS "left", coalesce(array_to_string(rt, ','), '') AS "right", coalesce(list_min(rt) < max(list_max(rt)) OVER (PARTITION BY doc_id ORDER BY row, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS moved FROM ly WINDOW w AS (PARTITION BY doc_id ORDER BY row, seq)""",
    "word_places": f"""WITH {_NODES}, w AS (SELECT doc_id, idx, regexp_extract_all(text, '[^\\s—–-]+|[\\s—–-]+') AS ws FROM n), u AS (SELECT doc_id, idx, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
        p AS (SELECT *, (coalesce(sum(length(word)) OVER (PARTITION BY doc_id, idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS s FROM u)
        SELECT doc_id, idx, s AS start, (s + length(word))::INT AS "end", word FROM p WHERE regexp_matches(word, '^[^\\s—–-]')""",
    "node_ranges": f"""WITH {_NODES}, r AS (SELECT doc_id, unnest(range(0, length(text) + 1, 150)) AS s FROM d),
        c AS (SELECT r.doc_id, f.idx, greatest(s - b, 0)::INT AS start, least(s + 90 - b, length(f.text))::INT AS "end" FROM r JOIN f ON r.doc_id = f.doc_id AND s < b + length(f.text) AND b < s + 90)
        SELECT * FROM c WHERE start < "end" """,
    "seeded_variants": f"""WITH {_NODES}, z AS (SELECT *, len(l) AS c FROM f),
        p AS (SELECT doc_id, c, l, idx AS p, CASE WHEN idx + idx // 5 % 3 < c THEN idx + idx // 5 % 3 ELSE idx END AS e, idx + idx // 5 % 3 < c AS two, CASE idx % 3 WHEN 0 THEN 'Lines not found in the second quarto' WHEN 1 THEN 'Text not found in the Folio' ELSE 'Editorial emendation' END AS d FROM z WHERE idx % 5 = 0),
        q AS (SELECT *, CASE WHEN NOT two THEN substr(l[p + 1], 3, 4) WHEN e = p THEN substr(l[p + 1], 3, 5) ELSE substr(l[p + 1], 3) || chr(10) || array_to_string(list_concat(l[p + 2:e], [left(l[e + 1], 7)]), chr(10)) END AS t FROM p),
        r AS (SELECT doc_id, p, e, d, c, l, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS flat, CASE WHEN p % 2 = 1 THEN p WHEN e > p THEN p + 1 END AS num FROM q),
        t AS (SELECT *, d || ': “' || CASE WHEN length(flat) > 60 THEN left(flat, 59) || '…' ELSE flat END || '”' || coalesce(' (1.1.' || num || ')', '') AS title FROM r WHERE flat <> ''),
        g AS (SELECT doc_id, idx AS o, unnest([idx, idx + 1]) AS m, 'q1-1600' AS version FROM z WHERE idx % 3 = 0 UNION ALL SELECT doc_id, idx * 5 % c, idx, 'f1-1623' FROM z WHERE idx % 4 <> 3),
        v AS (SELECT t.*, version FROM t, (VALUES ('q1-1600'), ('f1-1623')) x(version)),
        h AS (SELECT DISTINCT v.doc_id, p, v.version, o FROM v JOIN g ON g.doc_id = v.doc_id AND g.version = v.version AND m BETWEEN p AND e WHERE NOT (p % 3 = 1 AND v.version LIKE 'f1-%')),
        j AS (SELECT *, coalesce(o - lag(o) OVER w > 3, false)::INT AS b FROM h WINDOW w AS (PARTITION BY doc_id, p, version ORDER BY o)),
        k AS (SELECT *, sum(b) OVER (PARTITION BY doc_id, p, version ORDER BY o) AS run FROM j),
        s AS (SELECT doc_id, p, version, min(o) AS a, max(o) AS z FROM k WHERE run = 0 GROUP BY ALL)
        SELECT v.doc_id, v.p AS passage, title, v.version, a::INT AS start_idx, s.z::INT AS end_idx, (length(l[s.z + 1]) + 1)::INT AS end_off, coalesce(array_to_string(list_transform(l[a + 1:s.z + 1], lambda x: '>' || x), chr(10)), '') AS text FROM v LEFT JOIN s ON s.doc_id = v.doc_id AND s.p = v.p AND s.version = v.version""",
}
