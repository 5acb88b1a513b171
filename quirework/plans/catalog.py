"""Queries of lookups, ordered groupings, windows and checks over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import links, order


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def _words(text) -> F.Column:
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "")


def source_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = _t(spark, sf_dir, "nation").where("n_nationkey % 3 <> 2").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") % 3 == 0).alias("enabled"))
    return links.toggled(_t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), off, "c_nationkey").select("c_custkey", "c_nationkey")


def number_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select(F.concat_ws(".", (F.col("l_orderkey") % 12).cast("string"), F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string")).alias("number")).distinct()
    at = tx.number_parts(F.col("number"))
    return rows.where((at >= tx.number_parts(F.lit("2.3.40"))) & (at <= tx.number_parts(F.lit("10.2.7"))))


def fifth_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("number"))
    return rows.where(F.pmod(F.element_at(tx.number_parts(F.col("number")), -1), F.lit(5)) == 0)


def hidden_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of turns that are no user's, with the label of what is cut."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    run = _turns(spark, sf_dir).withColumn("shown", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w)).where("role <> 'user'")
    n = F.count("*")
    return run.groupBy("conv_id", "shown").agg(F.min("turn").alias("first_turn"), F.concat(n.cast("string"), F.when(n == 1, " line cut").otherwise(" lines cut")).alias("label"))


def default_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event type if it is one that still counts, else ``view``."""
    last = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    known = _t(spark, sf_dir, "events").where("value > 50").select("event_type", F.lit(True).alias("known")).distinct().where("length(event_type) % 2 = 1")
    return last.join(known, "event_type", "left").select("user_id", F.when(F.col("known"), F.col("event_type")).otherwise("view").alias("version"))


def scene_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("scene"), F.substring("n_name", 1, 1).alias("kind"))
    rows = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(n.select("c_nationkey", "kind"), "c_nationkey")
    return links.fallback_join(rows, n.where("c_nationkey % 2 = 0"), n, "c_nationkey", "kind", "scene").select("c_custkey", "scene")


def neighbour_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.neighbours(_turns(spark, sf_dir).drop("text"), ["conv_id"], "turn", "role", 2)


def pending_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _t(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("l_orderkey"))
    return links.pending(wanted, _t(spark, sf_dir, "lineitem").where("l_quantity > 45"), "l_orderkey")


def pruned_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _t(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("l_orderkey"))
    return links.pruned(_t(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber"), wanted, "l_orderkey")


def order_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders to parts by way of their lines' lists of part keys."""
    listed = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("works"))
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("work"), "p_brand")
    return listed.select("l_orderkey", F.explode("works").alias("work")).join(part, "work").select("l_orderkey", "work", "p_brand")


def first_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("at"), F.when(F.col("l_quantity") > 25, F.col("l_partkey")).alias("candidate"))
    return links.first_candidate(rows, ["l_orderkey"], "at", "candidate")


def ordered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").where("o_custkey % 10 = 1").select("o_custkey", "o_orderkey", "o_orderstatus")
    return links.ordered_groups(rows, "o_custkey", "o_orderkey", "o_orderstatus").select("o_custkey", "place", F.array_join("values", ",").alias("statuses"))


def merged_meanings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return links.distinct_in_order(rows, "o_custkey", "o_orderkey", "o_orderpriority").select("o_custkey", F.array_join("values", ",").alias("meanings"))


def anchor_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that lie at one anchor (order and quantity)."""
    anchor = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_quantity").cast("int").cast("string"))
    return _t(spark, sf_dir, "lineitem").groupBy(anchor.alias("anchor")).agg(F.count("*").alias("terms"), F.min("l_linenumber").alias("first_line")).where("terms > 1")


def merged_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.col("p_name")).alias("p_name"))
    return links.merged_entities(rows, "p_partkey", tx.title_key(F.regexp_replace("p_name", "[0-9]+", "")))


def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.concat_ws("-", "o_orderpriority", F.col("o_orderkey").cast("string"))).alias("revision"))


def best_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's supplier by weights of one over how many lines the supplier has."""
    lines = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    df = lines.groupBy("l_suppkey").agg(F.count("*").alias("df"))
    found = links.best_by_weight(order.dealt(lines, ["l_suppkey"]).join(df, "l_suppkey"), ["l_partkey"], "l_suppkey", 1 / F.col("df"))
    return found.select("l_partkey", "l_suppkey", F.round("weight", 6).alias("weight"))


def review_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _t(spark, sf_dir, "documents").select("doc_id", "source").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return told.groupBy("source").agg(F.count("*").alias("entries"), F.count("quality").alias("reviewed"), F.round(F.avg(F.col("quality").isNotNull().cast("int")), 6).alias("coverage"))


def document_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "n"))
    return lines.select("conv_id", "turn", "n", at.alias("place"), F.length("line").alias("width"))


def running_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roles so far, joined, at each turn."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return _turns(spark, sf_dir).select("conv_id", "turn", F.array_join(F.collect_list("role").over(w), " ").alias("so_far"))


def shown_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest user turns before and after each turn."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    shown = F.when(F.col("role") == "user", F.col("turn"))
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    return _turns(spark, sf_dir).select("conv_id", "turn", F.max(shown).over(before).alias("previous"), F.min(shown).over(after).alias("next"))


def line_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's share of its order, and how far into the order it lies."""
    w = Window.partitionBy("l_orderkey")
    so_far = w.orderBy("l_linenumber").rangeBetween(Window.unboundedPreceding, -1)
    total = F.sum("l_quantity").over(w)
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") / total, 6).alias("share"), F.round(F.coalesce(F.sum("l_quantity").over(so_far), F.lit(0.0)) / total, 6).alias("position"))


def following_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = _turns(spark, sf_dir).withColumn("w", F.slice(_words(F.col("text")), 1, 3))
    return links.following(short, ["conv_id"], "turn", F.col("w"), 6, 8).where("phrase is not null").select("conv_id", "turn", "phrase")


def top_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy(F.col("orders").desc(), F.col("total").desc(), "o_custkey").limit(20)


def natural_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' places by name with numbers by value, and by what is own, then imported, then generated."""
    rows = _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey"), F.concat(F.lit("s"), (F.col("s_suppkey") * 7919 % 1000).cast("string"), F.lit("x"), F.col("s_suppkey").cast("string")).alias("name"))
    rank = F.when(F.col("s_nationkey") % 3 == 0, 0).when(F.col("s_nationkey") % 3 == 1, 1).otherwise(2)
    by_name = Window.partitionBy("s_nationkey").orderBy(links.natural_key(F.col("name")))
    by_origin = Window.partitionBy((F.col("s_nationkey") % 5)).orderBy(rank, "s_suppkey")
    return rows.select("s_suppkey", F.row_number().over(by_name).alias("place"), F.row_number().over(by_origin).alias("origin_place"))


def shared_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct words a turn shares with the one before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _turns(spark, sf_dir).withColumn("w", F.array_distinct(_words(F.col("text"))))
    return rows.select("conv_id", "turn", links.shared_words(F.col("w"), F.lag("w").over(w)).alias("shared")).where("shared is not null")


def checked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the first check that they fail, null for valid ones; how many there are of each."""
    checks = {"unknown type": ~F.col("event_type").isin("view", "click", "purchase"), "too large": F.col("value") > 90, "no user": F.col("user_id") % 10 == 0}
    return _t(spark, sf_dir, "events").withColumn("reason", links.first_reason(checks)).groupBy("reason").agg(F.count("*").alias("items"), F.min("event_id").alias("first_event"))


def short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").select("item_id", links.truncated(F.col("text"), 40).alias("label"))


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of events' JSON properties, and the day and hour they fell on."""
    keys = F.array_join(F.array_sort(F.json_object_keys("props")), ",")
    return _t(spark, sf_dir, "events").select("event_id", keys.alias("keys"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").alias("hour"))


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), "c_name")
    new = c.where("node % 5 <> 0").withColumn("c_name", F.when(F.col("node") % 7 == 0, F.upper("c_name")).otherwise(F.col("c_name")))
    return links.change_log(c.where("node % 3 <> 0"), new, "node", "c_name")


def review_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = links.batched(_t(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), ["l_suppkey"], ["l_orderkey", "l_linenumber"], 40)
    return rows.groupBy("l_suppkey", "batch").agg(F.count("*").alias("items"), F.min("l_orderkey").alias("first_order"))


QUERIES = {f.__name__: f for f in (source_toggle, number_range, fifth_lines, hidden_labels, default_version, scene_fallback, neighbour_turns, pending_orders, pruned_answers, order_works, first_candidates, ordered_groups, merged_meanings, anchor_groups, merged_works, latest_revision, best_scene, review_coverage, document_order, running_roles, shown_neighbours, line_shares, following_phrases, top_totals, natural_places, shared_words, checked_items, short_texts, event_props, change_log, review_batches)}

_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda w: w <> '')"
ORACLE = {
    "source_toggle": "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey % 3 <> 1",
    "number_range": "SELECT DISTINCT a || '.' || b || '.' || c AS number FROM (SELECT l_orderkey % 12 AS a, l_linenumber AS b, l_quantity::INT AS c FROM lineitem) WHERE (a > 2 OR a = 2 AND (b > 3 OR b = 3 AND c >= 40)) AND (a < 10 OR a = 10 AND (b < 2 OR b = 2 AND c <= 7))",
    "fifth_lines": "SELECT l_orderkey, l_linenumber, l_orderkey || '.' || l_partkey AS number FROM lineitem WHERE l_partkey % 5 = 0",
    "hidden_labels": "WITH r AS (SELECT a.conv_id, a.turn, (SELECT count(*) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn AND b.role = 'user') AS shown FROM conversations a WHERE role <> 'user') SELECT conv_id, shown, min(turn) AS first_turn, count(*) || CASE count(*) WHEN 1 THEN ' line cut' ELSE ' lines cut' END AS label FROM r GROUP BY conv_id, shown",
    "default_version": "WITH l AS (SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, CASE WHEN length(event_type) % 2 = 1 AND event_type IN (SELECT event_type FROM events WHERE value > 50) THEN event_type ELSE 'view' END AS version FROM l",
    "scene_fallback": "SELECT c_custkey, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey ELSE (SELECT CASE WHEN min(m.n_regionkey) = max(m.n_regionkey) THEN min(m.n_regionkey) END FROM nation m WHERE m.n_name[1] = n.n_name[1]) END AS scene FROM customer JOIN nation n ON n_nationkey = c_nationkey",
    "neighbour_turns": "WITH o AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) SELECT conv_id, turn, role, coalesce((SELECT string_agg(b.role, '|' ORDER BY b.p) FROM o b WHERE b.conv_id = a.conv_id AND b.p BETWEEN a.p - 2 AND a.p - 1), '') AS before, coalesce((SELECT string_agg(b.role, '|' ORDER BY b.p) FROM o b WHERE b.conv_id = a.conv_id AND b.p BETWEEN a.p + 1 AND a.p + 2), '') AS \"after\" FROM o a",
    "pending_orders": "SELECT o_orderkey AS l_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)",
    "pruned_answers": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000)",
    "order_works": "SELECT DISTINCT l_orderkey, l_partkey AS work, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey",
    "first_candidates": "SELECT l_orderkey, first(l_partkey ORDER BY l_linenumber, l_partkey) FILTER (l_quantity > 25) AS candidate FROM lineitem GROUP BY l_orderkey",
    "ordered_groups": "SELECT o_custkey, min(o_orderkey) AS place, string_agg(o_orderstatus, ',' ORDER BY o_orderkey) AS statuses FROM orders WHERE o_custkey % 10 = 1 GROUP BY o_custkey",
    "merged_meanings": "WITH f AS (SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) = 1) SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY o_orderkey) AS meanings FROM f GROUP BY o_custkey",
    "anchor_groups": "SELECT l_orderkey || ':' || l_quantity::INT AS anchor, count(*) AS terms, min(l_linenumber) AS first_line FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "merged_works": "WITH k AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE regexp_replace(lower(regexp_replace(p_name, '[0-9]+', '', 'g')), '[^\\p{L}\\p{N}]', '', 'g') END AS k FROM part) SELECT p_partkey, CASE WHEN k = '' THEN p_partkey ELSE min(p_partkey) OVER (PARTITION BY k) END AS merged FROM k",
    "latest_revision": "SELECT o_custkey, max(o_orderpriority || '-' || o_orderkey) AS revision FROM orders GROUP BY o_custkey",
    "best_scene": "WITH d AS (SELECT l_suppkey, count(*) AS df FROM lineitem GROUP BY ALL), w AS (SELECT l_partkey, l_suppkey, round(count(*) / any_value(df), 9) AS w FROM lineitem JOIN d USING (l_suppkey) GROUP BY ALL) SELECT l_partkey, l_suppkey, round(w, 6) AS weight FROM w QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY w DESC, l_suppkey) = 1",
    "review_coverage": "SELECT source, count(*) AS entries, count(quality) AS reviewed, round(count(quality) / count(*), 6) AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
    "document_order": "WITH l AS (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS n FROM conversations) SELECT conv_id, turn, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, n) AS place, length(line) AS width FROM l",
    "running_roles": "SELECT a.conv_id, a.turn, (SELECT string_agg(b.role, ' ' ORDER BY b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn) AS so_far FROM conversations a",
    "shown_neighbours": "SELECT a.conv_id, a.turn, (SELECT max(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.role = 'user') AS previous, (SELECT min(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn > a.turn AND b.role = 'user') AS next FROM conversations a",
    "line_shares": "WITH t AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), u AS (SELECT a.l_orderkey, a.l_linenumber, sum(b.q) AS every, coalesce(sum(b.q) FILTER (b.l_linenumber < a.l_linenumber), 0) AS before FROM t a JOIN t b USING (l_orderkey) GROUP BY a.l_orderkey, a.l_linenumber) SELECT l_orderkey, l_linenumber, round(l_quantity / every, 6) AS share, round(before / every, 6) AS position FROM lineitem JOIN u USING (l_orderkey, l_linenumber)",
    "following_phrases": f"""WITH w AS (SELECT conv_id, turn, {_WORDS}[1:3] AS ws, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
e AS (SELECT conv_id, p, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM w), n AS (SELECT conv_id, p, sum(len(ws)) OVER (PARTITION BY conv_id ORDER BY p) - len(ws) AS base, len(ws) AS own, turn FROM w),
j AS (SELECT a.conv_id, a.turn, e.w, e.p, e.k, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY e.p, e.k) AS r FROM n a JOIN e ON e.conv_id = a.conv_id AND e.p BETWEEN a.p AND a.p + 5),
x AS (SELECT *, max(CASE WHEN r = 6 THEN p END) OVER (PARTITION BY conv_id, turn) AS last FROM j)
SELECT conv_id, turn, string_agg(w, ' ' ORDER BY r) AS phrase FROM x WHERE last IS NOT NULL AND p <= last AND r <= 8 GROUP BY conv_id, turn""",
    "top_totals": "SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey ORDER BY orders DESC, total DESC, o_custkey LIMIT 20",
    "natural_places": "WITH s AS (SELECT s_suppkey, s_nationkey, s_suppkey * 7919 % 1000 AS a FROM supplier) SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY a, s_suppkey) AS place, row_number() OVER (PARTITION BY s_nationkey % 5 ORDER BY s_nationkey % 3, s_suppkey) AS origin_place FROM s",
    "shared_words": f"WITH w AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, turn, {_WORDS} AS ws FROM conversations), e AS (SELECT DISTINCT conv_id, p, unnest(ws) AS w FROM w) SELECT a.conv_id, a.turn, (SELECT count(*) FROM e x JOIN e y ON x.w = y.w WHERE x.conv_id = a.conv_id AND y.conv_id = a.conv_id AND x.p = a.p AND y.p = a.p - 1) AS shared FROM w a WHERE a.p > 1",
    "checked_items": "WITH r AS (SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'unknown type' WHEN value > 90 THEN 'too large' WHEN user_id % 10 = 0 THEN 'no user' END AS reason FROM events) SELECT reason, count(*) AS items, min(event_id) AS first_event FROM r GROUP BY reason",
    "short_texts": "SELECT item_id, CASE WHEN length(text) > 40 THEN rtrim(text[1:39]) || '…' ELSE text END AS label FROM benchmark",
    "event_props": "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys, strftime(ts, '%Y-%m-%d') AS day, hour(ts)::INT AS hour FROM events",
    "change_log": "SELECT c_custkey AS node, CASE WHEN c_custkey % 3 = 0 THEN 'added' WHEN c_custkey % 5 = 0 THEN 'removed' ELSE 'changed' END AS change FROM customer WHERE (c_custkey % 3 = 0 AND c_custkey % 5 <> 0) OR (c_custkey % 3 <> 0 AND (c_custkey % 5 = 0 OR c_custkey % 7 = 0 AND upper(c_name) <> c_name))",
    "review_batches": "WITH b AS (SELECT l_suppkey, l_orderkey, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1) // 40 AS batch FROM lineitem) SELECT l_suppkey, batch, count(*) AS items, min(l_orderkey) AS first_order FROM b GROUP BY ALL",
}
