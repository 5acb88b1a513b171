"""Queries of citations, notes, curated alignments and quotation links over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import citations, curation, notes, order


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of about 20 documents each, with all their lines."""
    docs = order.spread(_t(spark, sf_dir, "documents").select("doc_id", "text"))
    scene = F.floor(F.col("doc_id") / 20).cast("long")
    rows = order.lines(docs).withColumn("scene", scene)
    idx = F.row_number().over(Window.partitionBy("scene").orderBy("doc_id", "n"))
    words = F.filter(F.split(F.lower("line"), "[^a-z]+"), lambda w: w != "")
    return rows.withColumn("idx", idx).select("scene", "idx", F.col("idx").alias("number"), words.alias("words"))


def citation_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A citation of every seventh line: its fifth word, one to eight words behind it, a drifting number; some in a wrong scene or far off."""
    lines = _scenes(spark, sf_dir)
    drift = F.floor(F.col("idx") / 12).cast("int")
    cited = lines.where("idx % 7 = 3").select(
        (F.col("scene") * 100000 + F.col("idx")).alias("id"),
        F.when(F.col("idx") % 35 == 3, F.lit(-1)).otherwise(F.col("scene")).alias("scene"),
        F.when(F.col("idx") % 35 == 10, F.lit(5000)).otherwise(F.col("idx") + drift).alias("line"),
        F.try_element_at("words", F.lit(5)).alias("head"),
        F.expr("slice(words, 6, 1 + idx % 8)").alias("quote"),
    )
    return citations.match(lines, cited)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notes: every third customer's are changed, and the date is their content."""
    o = _t(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), (F.col("o_custkey") % 3 == 0).alias("modified"), (F.col("o_custkey") % 4 == 1).alias("own"), F.col("o_orderstatus").alias("version"), F.col("o_orderpriority").alias("text"), F.col("o_orderdate").alias("created"))


def merged_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, m = _orders(spark, sf_dir), lambda k: F.pmod(F.col("c"), F.lit(k))
    local, incoming = o.where(m(2) == 0), o.where(m(5) < 3).withColumn("text", F.concat(F.lit("new "), "text")).withColumn("n", F.col("c"))
    return notes.merged(local, incoming, o.where(m(7) == 0), o.where(m(14) == 7), ["text", "version"])


def saved_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    edits = o.where("id % 5 = 0").select("id", F.upper("version").alias("version"), F.lower("text").alias("text"))
    return notes.saved(o, edits, ["text", "version"]).select("id", "text", "version", "modified")


def note_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    return notes.tombstones(o, o.where("id % 6 = 0"))


def copy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A free copy name for every brand in each type, where parts of odd sizes have taken some."""
    p = _t(spark, sf_dir, "part").select(F.col("p_type").alias("type"), F.col("p_brand").alias("name"), "p_size").where("p_size % 2 = 1")
    suffix = F.when(F.col("p_size") > 1, F.concat(F.lit(" "), F.col("p_size").cast("string"))).otherwise("")
    some = p.where("p_size <= 5").select("type", F.concat("name", F.lit(" (copy"), suffix, F.lit(")")).alias("name")).distinct()
    return notes.free_names(p.select("type", "name").distinct(), some, "type", "name", notes.copy_name("name"))


def import_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    return notes.import_plan(o.withColumn("attached", F.col("id") % 11 != 0), o.where("id % 9 = 0"), "version", "text")


def exported_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.exported(_orders(spark, sf_dir), "created").select("version", "place", "id")


def cited_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of an order's lines as citations; the notes are the orders of even keys."""
    c = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("n"), F.col("l_partkey").cast("string").alias("citation"))
    own = _t(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("line"), (F.col("o_orderkey") + 7).alias("id"))
    return notes.cited(own, c, "line", "n").select("line", "id", F.array_join("citations", ",").alias("citations"))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as nodes in scenes of four; the user's turns have numbers."""
    t = _t(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("idx"), "role").distinct()
    scene = F.floor(F.col("idx") / 4).cast("int")
    return t.select("conv_id", "idx", F.concat(F.lit("s"), scene.cast("string")).alias("scene"), F.when(F.col("role") == "user", F.concat(scene.cast("string"), F.lit("."), (F.col("idx") + 1).cast("string"))).alias("number"))


def node_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.fragments(_numbered(spark, sf_dir), "conv_id", "scene")


def resolved_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back from fragments to nodes, each also one step and nine steps on."""
    n = _numbered(spark, sf_dir)
    made = notes.fragments(n, "conv_id", "scene")
    base = F.split_part("fragment", F.lit("+"), F.lit(1))
    wanted = made.select("conv_id", "fragment").unionByName(made.select("conv_id", F.concat(base, F.lit("+1")).alias("fragment"))).unionByName(made.select("conv_id", F.concat(base, F.lit("+9")).alias("fragment")))
    return notes.resolved(wanted, n, "conv_id", "scene")


def curated_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry a line of an order, with two nodes a side; a curated one over the second nodes of lines 2 and 3."""
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("int").alias("entry")).distinct()
    pair = F.array(F.col("entry") * 2, F.col("entry") * 2 + 1)
    entries = li.select("o", "entry", pair.alias("orig"), pair.alias("modern"), F.lit("same").alias("relation"))
    curated = li.where("entry = 2").select("o", F.lit(1).alias("k"), F.array(F.lit(5), F.lit(6)).alias("orig"), F.array(F.lit(5)).alias("modern"), F.lit("variant").alias("relation"))
    done = curation.curated_alignment(entries, curated, "o")
    return done.select("o", "entry", "turn", F.array_join("orig", ",").alias("orig"), F.array_join("modern", ",").alias("modern"), "relation", "status")


_SHARE = 0.45


def _works(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    works = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("work"), F.concat("p_name", F.lit(" "), "p_brand").alias("title"), F.col("p_size").alias("year"), F.col("p_type").alias("field"))
    return works, _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line"), F.col("l_partkey").alias("work"))


def quoting_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as works, equal but for spaces in name and brand, and orders as lines, of which every tenth is gone."""
    works, links = _works(spark, sf_dir)
    return curation.quotation_links(works, links, links.where("line % 10 <> 0"), works.where("work % 50 = 0"), tx.title_key(F.col("title")), "ECONOMY", 100, _SHARE)


def live_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the orders of odd keys find beyond the works of the smallest sizes."""
    works, links = _works(spark, sf_dir)
    found = links.where("line % 2 = 1").join(works, "work")
    out = curation.live_works(found, works.where("year <= 3"), works.where("work % 17 = 0"), tx.title_key(F.col("title")), "ECONOMY")
    return out.select("key", "work", F.size("lines").alias("lines"))


QUERIES = {f.__name__: f for f in (citation_matches, merged_notes, saved_notes, note_tombstones, copy_names, import_plans, exported_notes, cited_notes, node_fragments, resolved_fragments, curated_entries, quoting_works, live_results)}

_SCENES = r"""d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), e AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM d),
ln AS (SELECT doc_id // 20 AS scene, (row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id, n))::INT AS idx, list_filter(regexp_split_to_array(lower(line), '[^a-z]+'), lambda x: x <> '') AS words FROM e),
lc AS (SELECT *, list_distinct(list_concat(coalesce(lag(words) OVER o, []), words, coalesce(lead(words) OVER o, []))) AS context FROM ln WINDOW o AS (PARTITION BY scene ORDER BY idx)),
wd AS (SELECT scene, idx, unnest(words) AS word, (generate_subscripts(words, 1) - 1)::INT AS "at" FROM ln)"""
_NUMBERED = """nu AS (SELECT DISTINCT conv_id, turn::INT AS idx, 's' || (turn // 4) AS scene, CASE WHEN role = 'user' THEN (turn // 4) || '.' || (turn + 1) END AS number FROM conversations),
fl AS (SELECT *, last_value(CASE WHEN number IS NOT NULL THEN idx END IGNORE NULLS) OVER o AS na, last_value(number IGNORE NULLS) OVER o AS no, min(idx) OVER (PARTITION BY conv_id, scene) AS s0 FROM nu WINDOW o AS (PARTITION BY conv_id, scene ORDER BY idx)),
fr AS (SELECT conv_id, idx, coalesce(no, scene) || CASE WHEN idx > coalesce(na, s0) THEN '+' || (idx - coalesce(na, s0)) ELSE '' END AS fragment FROM fl)"""
_TITLED = "sa AS (SELECT p_partkey AS work, regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]', '', 'g') AS key, min(p_partkey) OVER (PARTITION BY regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]', '', 'g')) AS canonical FROM part)"
ORACLE = {
    "citation_matches": f"""WITH {_SCENES},
c0 AS (SELECT scene * 100000 + idx AS id, CASE WHEN idx % 35 = 3 THEN -1 ELSE scene END AS scene, CASE WHEN idx % 35 = 10 THEN 5000 ELSE idx + idx // 12 END AS line, words[5] AS head, words[6:6 + idx % 8] AS quote FROM ln WHERE idx % 7 = 3),
c AS (SELECT id, scene, line, head, list_distinct(list_filter(quote, lambda k: length(k) > 2 AND NOT (starts_with(k, head) AND length(k) - length(head) <= 3))) AS q FROM c0 WHERE length(head) >= 2),
cn AS (SELECT *, len(q) AS nq, greatest(3, ceil(len(q) * 0.6)) AS needed FROM c),
m AS (SELECT cn.id, cn.scene AS own, cn.line, cn.nq, cn.needed, wd.scene, wd.idx, wd."at", len(list_intersect(cn.q, lc.context)) AS ov
  FROM cn JOIN wd ON starts_with(wd.word, cn.head) AND length(wd.word) - length(cn.head) <= 3 AND (wd.scene = cn.scene OR cn.nq >= 3) JOIN lc ON lc.scene = wd.scene AND lc.idx = wd.idx),
i AS (SELECT * FROM m WHERE scene = own),
pr AS (SELECT id, scene, any_value(line) AS cited, min(idx) AS num FROM i WHERE nq >= 3 AND ov >= needed GROUP BY ALL HAVING count(DISTINCT idx) = 1),
nr AS (SELECT cn.id, num - cited AS o, row_number() OVER (PARTITION BY cn.id ORDER BY abs(cited - cn.line), cited, pr.id) AS r FROM cn JOIN pr USING (scene)),
md AS (SELECT id, list_sort(list(o))[count(*) // 2 + 1] AS o FROM nr WHERE r <= 5 GROUP BY id),
nc AS (SELECT i.*, abs(idx - line - coalesce(o, 0)) AS dist FROM i LEFT JOIN md USING (id) WHERE abs(idx - line - coalesce(o, 0)) <= 15),
lg AS (SELECT *, row_number() OVER w AS r, lead(idx) OVER w AS i2, lead(ov) OVER w AS ov2, lead(dist) OVER w AS d2 FROM nc WHERE nq >= 3 AND ov >= 2 WINDOW w AS (PARTITION BY id ORDER BY ov DESC, dist, idx, "at")),
sl AS (SELECT id, idx, max("at") AS "at", any_value(dist) AS dist FROM nc WHERE nq < 3 GROUP BY id, idx),
sh AS (SELECT *, row_number() OVER w AS r, lead(dist) OVER w AS d2 FROM sl WINDOW w AS (PARTITION BY id ORDER BY dist, idx)),
ch AS (SELECT id, idx, "at", CASE WHEN i2 <> idx AND ov2 = ov AND d2 = dist THEN 'ambiguous' END AS why FROM lg WHERE r = 1 UNION ALL SELECT id, idx, "at", CASE WHEN d2 IS NULL OR (dist <= 3 AND d2 - dist >= 8) THEN NULL ELSE 'ambiguous' END FROM sh WHERE r = 1),
st AS (SELECT cn.id, cn.scene, ch.idx, ch."at", CASE WHEN cn.scene NOT IN (SELECT scene FROM ln) THEN 'no such scene' WHEN cn.id NOT IN (SELECT id FROM nc) THEN 'headword not found near cited line' WHEN ch.id IS NULL THEN 'quotation disagrees' ELSE why END AS why FROM cn LEFT JOIN ch USING (id)),
h AS (SELECT id, min(scene) AS scene, min(idx) AS idx, min("at") AS "at" FROM i WHERE nq >= 3 AND ov >= needed GROUP BY id HAVING count(DISTINCT idx) = 1),
f AS (SELECT id, min(scene) AS scene, min(idx) AS idx, min("at") AS "at" FROM m WHERE nq >= 3 AND ov >= needed GROUP BY id HAVING count(DISTINCT (scene, idx)) = 1),
x AS (SELECT st.id, st.why, st.scene AS s0, st.idx AS i0, st."at" AS a0, coalesce(st.why <> 'ambiguous', false) AS lost, h.scene AS s1, h.idx AS i1, h."at" AS a1, f.scene AS s2, f.idx AS i2, f."at" AS a2 FROM st LEFT JOIN h USING (id) LEFT JOIN f USING (id))
SELECT id, CASE WHEN why IS NULL THEN s0 WHEN lost THEN coalesce(s1, s2) END AS scene, CASE WHEN why IS NULL THEN i0 WHEN lost THEN coalesce(i1, i2) END AS idx, CASE WHEN why IS NULL THEN a0 WHEN lost THEN coalesce(a1, a2) END AS "at", lost AND coalesce(i1, i2) IS NOT NULL AS recovered, CASE WHEN lost AND coalesce(i1, i2) IS NOT NULL THEN NULL ELSE why END AS reason FROM x
UNION ALL SELECT id, NULL, NULL, NULL, false, 'unsupported headword' FROM c0 WHERE head IS NULL OR length(head) < 2""",
    "merged_notes": """WITH o AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderpriority AS t, o_orderstatus AS v FROM orders),
f AS (SELECT id, t, v, c % 3 = 0 AS m, c % 2 = 0 AS here, c % 5 < 3 AS comes, c % 7 = 0 AND c % 14 <> 7 AS gone FROM o)
SELECT id, CASE WHEN here AND (m OR (gone AND comes)) THEN t ELSE 'new ' || t END AS text, v AS version, here AND m AS modified, here AND m AND NOT comes AS removed_from_source FROM f WHERE (here AND (m OR comes)) OR (NOT here AND comes AND NOT gone)""",
    "saved_notes": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS text, CASE WHEN o_orderkey % 5 = 0 THEN upper(o_orderstatus) ELSE o_orderstatus END AS version, o_custkey % 3 = 0 OR (o_orderkey % 5 = 0 AND o_custkey % 4 <> 1) AS modified FROM orders",
    "note_tombstones": "SELECT o_orderkey AS id FROM orders WHERE o_custkey % 4 <> 1 AND o_orderkey % 6 = 0",
    "copy_names": """WITH p AS (SELECT DISTINCT p_type AS type, p_brand AS name FROM part WHERE p_size % 2 = 1), t AS (SELECT DISTINCT p_type AS type, p_brand || ' (copy' || CASE WHEN p_size > 1 THEN ' ' || p_size ELSE '' END || ')' AS free FROM part WHERE p_size IN (1, 3, 5)),
c AS (SELECT type, name, k, name || ' (copy' || CASE WHEN k > 1 THEN ' ' || k ELSE '' END || ')' AS free FROM p, range(1, 10) r(k)) SELECT type, name, arg_min(free, k) AS free FROM c ANTI JOIN t USING (type, free) GROUP BY ALL""",
    "import_plans": "SELECT o_orderstatus AS version, o_orderpriority AS text, count(*) AS items, count(*) FILTER (o_orderkey % 11 = 0) AS unattached, count(*) FILTER (o_orderkey % 9 = 0) AS deleted_before FROM orders GROUP BY ALL",
    "exported_notes": "SELECT o_orderstatus AS version, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS place, o_orderkey AS id FROM orders WHERE o_custkey % 4 = 1",
    "cited_notes": "SELECT l_orderkey AS line, CASE WHEN l_orderkey % 2 = 0 AND l_orderkey IN (SELECT o_orderkey FROM orders) THEN l_orderkey + 7 END AS id, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS citations FROM lineitem GROUP BY l_orderkey",
    "node_fragments": f"WITH {_NUMBERED} SELECT conv_id, idx, fragment FROM fr",
    "resolved_fragments": f"""WITH {_NUMBERED}, wa AS (SELECT conv_id, unnest([fragment, split_part(fragment, '+', 1) || '+1', split_part(fragment, '+', 1) || '+9']) AS fragment FROM fr),
wb AS (SELECT DISTINCT conv_id, fragment, split_part(fragment, '+', 1) AS base, CASE WHEN contains(fragment, '+') THEN split_part(fragment, '+', 2)::INT ELSE 0 END AS off FROM wa),
wc AS (SELECT *, (SELECT min(idx) FROM nu WHERE nu.conv_id = wb.conv_id AND nu.number = base) AS li, (SELECT min(idx) FROM nu WHERE nu.conv_id = wb.conv_id AND nu.scene = base) AS st FROM wb)
SELECT conv_id, fragment, (SELECT min(idx) FROM nu WHERE nu.conv_id = wc.conv_id AND nu.idx = coalesce(li, st) + off AND (li IS NOT NULL OR nu.scene = base)) AS idx FROM wc""",
    "curated_entries": """WITH li AS (SELECT DISTINCT l_orderkey AS o, l_linenumber::INT AS e FROM lineitem), t AS (SELECT o FROM li WHERE e = 2), has3 AS (SELECT o FROM li WHERE e = 3)
SELECT o, e AS entry, 1 AS turn, (e * 2) || ',' || (e * 2 + 1) AS orig, (e * 2) || ',' || (e * 2 + 1) AS modern, 'same' AS relation, 'auto' AS status FROM li WHERE NOT (e IN (2, 3) AND o IN (SELECT o FROM t))
UNION ALL SELECT o, 2, unnest([1, 2, 3]), unnest(['5,6', '4', '']), unnest(['5', '', '4']), unnest(['variant', 'orig-only', 'modern-only']), unnest(['reviewed', 'auto', 'auto']) FROM t
UNION ALL SELECT o, 3, unnest([1, 2, 3]), unnest(['7', '', '']), unnest(['', '6', '7']), unnest(['orig-only', 'modern-only', 'modern-only']), 'auto' FROM t JOIN has3 USING (o)""",
    "quoting_works": f"""WITH {_TITLED}, li AS (SELECT DISTINCT l_orderkey AS line, canonical FROM lineitem JOIN sa ON work = l_partkey), re AS (SELECT canonical FROM li GROUP BY canonical HAVING count(*) >= 100 * {_SHARE})
SELECT line, row_number() OVER (PARTITION BY line ORDER BY p_size DESC, p_name || ' ' || p_brand, canonical) AS place, canonical AS work FROM li JOIN part ON p_partkey = canonical
WHERE line % 10 <> 0 AND p_type = 'ECONOMY' AND canonical NOT IN (SELECT canonical FROM re) AND canonical NOT IN (SELECT canonical FROM sa WHERE work % 50 = 0)""",
    "live_results": f"""WITH {_TITLED}, fo AS (SELECT DISTINCT key, work, l_orderkey AS line FROM lineitem JOIN sa ON work = l_partkey JOIN part ON p_partkey = work WHERE l_orderkey % 2 = 1 AND p_type = 'ECONOMY' AND work % 17 <> 0 AND key NOT IN (SELECT key FROM sa JOIN part ON p_partkey = work WHERE p_size <= 3))
SELECT key, arg_min(work, (line, work)) AS work, count(DISTINCT line)::INT AS lines FROM fo GROUP BY key""",
}
