"""Queries of the library over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import intervals, merge, order, sequences
from ..streaming import changes


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_key_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.spread(_t(spark, sf_dir, "documents")).select(F.explode(tx.keys(F.col("text"))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def _grams_of(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """``(id, at, gram, check)`` of a text's keys; the keys are a column of their own, so that they are made once a row."""
    return order.spread(df).select(F.col(id_col).alias("id"), tx.keys(F.col("text")).alias("k")).select("id", F.inline(order.ngrams(F.col("k"), n)))


def _unique_grams(df: DataFrame, id_col: str, n: int = 5) -> DataFrame:
    """A text's key n-grams that occur once in it, with their place."""
    grams = _grams_of(df, id_col, n)
    return grams.groupBy("id", "gram", "check").agg(F.min("at").alias("at"), F.count("*").alias("c")).where("c = 1").drop("c")


def _landmark_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _unique_grams(_t(spark, sf_dir, "benchmark"), "item_id").withColumnsRenamed({"id": "item_id", "at": "item_at"})
    grams = _grams_of(_t(spark, sf_dir, "documents"), "doc_id", 5)
    # only grams of items can meet one, so the rest go before the count
    near = grams.join(items.select("gram", "check").distinct(), ["gram", "check"], "left_semi").groupBy("id", "gram", "check").agg(F.min("at").alias("at"), F.count("*").alias("c")).where("c = 1")
    return near.join(items, ["gram", "check"]).select(F.col("id").alias("doc_id"), "item_id", "at", "item_at")


def landmark_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landmark_pairs(spark, sf_dir).groupBy("doc_id", "item_id").agg(F.count("*").alias("landmarks"), F.min("at").alias("first_at"))


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chained = sequences.chains(_landmark_pairs(spark, sf_dir), ["doc_id", "item_id"], "at", "item_at")
    return chained.groupBy("doc_id", "item_id").agg(F.count("*").alias("landmarks"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.lines(_t(spark, sf_dir, "documents"))


def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.running_offset(_lines(spark, sf_dir), ["doc_id"], "n", F.length("line") + 1).select("doc_id", "n", F.col("offset").cast("long").alias("offset"))


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _lines(spark, sf_dir).where("line <> ''").groupBy("line").agg(F.min(F.struct("doc_id", "n")).alias("f"), F.count("*").alias("uses"))
    return first.where("uses > 1").select("f.doc_id", "f.n", "uses")


def majority_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.majority(_t(spark, sf_dir, "conversations"), ["conv_id"], "role")


def role_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return order.islands(turns, ["conv_id"], "turn", before == F.col("role")).groupBy("conv_id", "island").agg(F.min("turn").alias("first_turn"), F.count("*").alias("turns"), F.min("role").alias("role"))


def counterparts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("modern"))
    return order.counterpart(turns, ["conv_id"], "turn", "modern")


def moved_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.moved(_t(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value")


def last_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.latest(_t(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "value", "event_id").select("user_id", "event_type", "value")


def candidate_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of letters in few documents that are not short, not Roman numerals and not in the benchmark."""
    word = lambda t, k: order.spread(_t(spark, sf_dir, t)).select(k, F.explode(F.array_distinct(F.transform(tx.candidates(F.col("text")), F.lower))).alias("word"))
    own = word("documents", "doc_id").where((F.length("word") > 2) & ~F.col("word").rlike("^[ivxlcdm]+$"))
    known = word("benchmark", "item_id").select("word").distinct()
    return own.groupBy("word").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc")).where("docs between 2 and 5").join(known, "word", "left_anti")


def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.hash_sample(_t(spark, sf_dir, "labels"), "review", F.col("doc_id").cast("string"), 100).select("doc_id", "quality", "rank_hash")


def review_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = review_sample(spark, sf_dir)
    told = sample.agg(F.count("*").alias("sampled"), F.count_if(F.col("quality").isNull()).alias("unreviewed"), F.count_if(F.col("quality") == 0).alias("rejected"))
    state = F.when(F.col("unreviewed") > 0, "unreviewed").when(F.col("rejected") * 10 > F.col("sampled"), "withheld").otherwise("shipped")
    return told.withColumn("state", state)


def import_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 3 == 0).alias("modified"), "o_custkey")
    m = lambda k: F.pmod(F.col("o_custkey"), F.lit(k))
    local, incoming = o.where(m(2) == 0), o.where(m(5) < 3).select("id", F.col("o_custkey").alias("n"))
    return merge.import_merge(local, incoming, o.where(m(7) == 0), o.where(m(14) == 7))


def revision_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("text"))
    new = c.where("key % 5 <> 0").withColumn("text", F.when(F.col("key") % 7 == 0, F.upper("text")).otherwise(F.col("text")))
    return merge.stable_ids(c.where("key % 3 <> 0"), new)


def reprint_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that quote at least a quarter of the items that anything quotes, and how many."""
    links = landmark_links(spark, sf_dir).join(_t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    per = links.groupBy("source").agg(F.countDistinct("item_id").alias("items"), F.min("doc_id").alias("least_doc"))
    every = links.select("item_id").distinct().agg(F.count("*").alias("every"))
    return per.crossJoin(F.broadcast(every)).select("source", "items", "least_doc", (F.col("items") * 4 >= F.col("every")).alias("reprint"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    return _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), q.alias("start"), (q + F.col("l_linenumber") * 2).cast("int").alias("end"), F.col("l_linenumber").cast("int").alias("line"))


def _hull(spans: DataFrame) -> DataFrame:
    """One interval a node, around its spans of line 1."""
    return spans.where("line = 1").groupBy("node").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def span_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spans(spark, sf_dir)
    return intervals.overlaps(s.where("line % 2 = 0").drop("line"), s.where("line % 2 = 1").drop("line"), "node").groupBy("node").agg(F.count("*").alias("pairs"))


def free_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spans(spark, sf_dir)
    return intervals.overlaps(s.where("line % 2 = 0"), s.where("line % 2 = 1").drop("line"), "node", "left_anti")


def hidden_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spans(spark, sf_dir)
    return intervals.add_hide(s.where("line > 1").drop("line"), _hull(s), ["node"])


def restored_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spans(spark, sf_dir)
    return intervals.restore(s.where("line > 1").drop("line"), _hull(s), ["node"])


def span_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.segments(_spans(spark, sf_dir).drop("line"), ["node"])


def covered_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spans(spark, sf_dir).groupBy("node").agg(F.collect_list(F.struct((F.col("start") - 20).alias("start"), "end")).alias("ranges"))
    return s.select("node", intervals.covers(F.col("ranges"), F.lit(30)).alias("covered"))


def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_quantity")).alias("q"))
    return sizes.select("l_orderkey", F.element_at("q", (F.floor(F.size("q") / 2) + 1).cast("int")).cast("double").alias("median"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", tx.safe_url(F.col("url")).alias("safe"), tx.slug(F.substring_index(F.col("url"), "://", -1)).alias("slug"))


def rare_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's weight of 1/df over its distinct key trigrams that benchmark items hold."""
    grams = lambda t, k: _grams_of(_t(spark, sf_dir, t), k, 3).select(F.col("id").alias(k), "gram", "check")
    known = grams("benchmark", "item_id").distinct().groupBy("gram", "check").agg(F.count("*").alias("df"))
    weight = F.round(F.sum(1 / F.col("df")), 6).alias("weight")
    # only grams of items count, so the rest go before the distinct ones are sought
    return grams("documents", "doc_id").join(known, ["gram", "check"]).distinct().groupBy("doc_id").agg(weight, F.count("*").alias("grams"))


def recurrence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.recurrence(_t(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role")


def next_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("shown"))
    return order.fill_backward(turns, ["conv_id"], "turn", "shown")


def nearest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return order.nearest(lines, ["l_orderkey"], F.abs(F.col("l_quantity") - 25), ["l_linenumber", "l_quantity"], 2)


def clear_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.clear_best(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", "l_linenumber", 8)


def lines_in_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order whose quantities lie within five of each other: the range is checked inside an equi join."""
    a = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    b = a.select("l_orderkey", F.col("l_linenumber").alias("other"), F.col("l_quantity").alias("q"))
    return a.join(b, "l_orderkey").where((F.col("l_linenumber") < F.col("other")) & F.col("q").between(F.col("l_quantity") - 5, F.col("l_quantity") + 5)).select("l_orderkey", "l_linenumber", "other")


def conversation_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen digits of the hash of each node's id, a tab, its text and a line end, in order."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda t: F.concat(t["turn"].cast("string"), F.lit("\t"), t["text"], F.lit("\n")))
    return _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.substring(F.sha2(F.array_join(turns, ""), 256), 1, 16).alias("revision"))


def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each nation, in one segment and in the others; nations without any are left out."""
    own = F.col("c_mktsegment") == "BUILDING"
    counted = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count_if(own).alias("own"), F.count_if(~own).alias("imported"))
    return _t(spark, sf_dir, "nation").select("n_nationkey", "n_name").join(counted, "n_nationkey")


def edit_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = changes.sessions(_t(spark, sf_dir, "events").select("user_id", "ts"), ["user_id"], "ts", "6 hours")
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


QUERIES = {f.__name__: f for f in (word_key_freq, landmark_links, landmarks, line_offsets, first_lines, majority_role, role_runs, counterparts, moved_events, last_position, candidate_terms, review_sample, review_gate, import_outcomes, revision_changes, reprint_sources, span_overlaps, free_spans, hidden_spans, restored_spans, span_segments, covered_nodes, upper_median, page_links, rare_trigrams, recurrence_labels, next_shown, nearest_lines, clear_leads, lines_in_reach, conversation_hash, collection_counts, edit_sessions)}

_single = "k"
for _c in "abcdefghijklmnopqrstuvwxyz":
    _single = f"regexp_replace({_single}, '{_c}{_c}+', '{_c}', 'g')"
#: Keys of the words of ``t(id, text)``, one row a word, numbered; in steps that mirror the rule.
_KEYS = f"""
w AS (SELECT id, generate_subscripts(ws, 1) AS p, unnest(ws) AS w FROM (SELECT id, regexp_split_to_array(replace(coalesce(text, ''), '&', ' and '), '[\\s—–-]+') AS ws FROM t)),
k1 AS (SELECT id, p, regexp_replace(replace(regexp_replace(translate(strip_accents(lower(w)), 'ſvjy', 'suii'), '[^a-z]', '', 'g'), 'ck', 'c'), '^$', '') AS k FROM w),
k2 AS (SELECT id, p, {_single} AS k FROM k1),
k3 AS (SELECT id, p, CASE WHEN length(k) > 1 THEN regexp_replace(k, 'e$', '') ELSE k END AS k FROM k2),
keys AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY p) - 1 AS pos, regexp_replace(regexp_replace(k, '(..)ed$', '\\1d'), '([pkcsx])t$', '\\1d') AS k FROM k3 WHERE k <> '')"""
_SPANS = "s AS (SELECT l_orderkey AS node, l_quantity::INT AS start, (l_quantity::INT + l_linenumber * 2)::INT AS \"end\", l_linenumber::INT AS line FROM lineitem)"
_LINES = "l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, (generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1)::INT AS n FROM documents)"


def _grams(n: int, t: str) -> str:
    rest = "".join(f" || ' ' || lead(k, {i}) OVER o" for i in range(1, n))
    return f"(WITH t AS (SELECT {t}), {_KEYS} SELECT id, pos, gram FROM (SELECT id, pos, k{rest} AS gram FROM keys WINDOW o AS (PARTITION BY id ORDER BY pos)) WHERE gram IS NOT NULL)"


_LINKS = f"""
d AS (SELECT id, gram, min(pos) AS pos FROM {_grams(5, 'doc_id AS id, text FROM documents')} GROUP BY ALL HAVING count(*) = 1),
i AS (SELECT id, gram FROM {_grams(5, 'item_id AS id, text FROM benchmark')} GROUP BY ALL HAVING count(*) = 1),
links AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS landmarks, min(pos)::INT AS first_at FROM d JOIN i USING (gram) GROUP BY ALL)"""
ORACLE = {
    "word_key_freq": f"WITH t AS (SELECT doc_id AS id, text FROM documents), {_KEYS} SELECT k AS key, count(*) AS n FROM keys GROUP BY k",
    "landmark_links": f"WITH {_LINKS} SELECT * FROM links",
    "line_offsets": f"WITH {_LINES} SELECT doc_id, n, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM l",
    "first_lines": f"WITH {_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, n) AS rn, count(*) OVER (PARTITION BY line) AS uses FROM l WHERE line <> '') SELECT doc_id, n, uses FROM r WHERE rn = 1 AND uses > 1",
    "majority_role": "WITH c AS (SELECT conv_id, role, count(*) AS v FROM conversations GROUP BY ALL) SELECT conv_id, first(role ORDER BY v DESC, role) AS role, sum(v)::BIGINT AS \"of\" FROM c GROUP BY conv_id",
    "role_runs": "WITH a AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS g FROM conversations), b AS (SELECT conv_id, role, g, min(turn) AS first_turn, count(*) AS turns FROM a GROUP BY ALL) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY first_turn) AS island, first_turn, turns, role FROM b",
    "counterparts": "SELECT a.conv_id, a.turn, (SELECT max(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn AND b.role = 'user') AS modern FROM conversations a",
    "moved_events": "SELECT user_id, event_id, value, coalesce(value < max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS moved FROM events",
    "last_position": "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL",
    "candidate_terms": "WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}+(?:[''’]\\p{L}+)*')) AS word FROM documents), k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{L}+(?:[''’]\\p{L}+)*')) AS word FROM benchmark) SELECT word, count(*) AS docs, min(doc_id) AS first_doc FROM w WHERE length(word) > 2 AND NOT regexp_matches(word, '^[ivxlcdm]+$') AND word NOT IN (SELECT word FROM k) GROUP BY word HAVING count(*) BETWEEN 2 AND 5",
    "review_sample": "SELECT doc_id, quality, sha256('review:' || doc_id) AS rank_hash FROM labels ORDER BY rank_hash LIMIT 100",
    "review_gate": "WITH s AS (SELECT quality FROM labels ORDER BY sha256('review:' || doc_id) LIMIT 100), a AS (SELECT count(*) AS sampled, count(*) FILTER (quality IS NULL) AS unreviewed, count(*) FILTER (quality = 0) AS rejected FROM s) SELECT *, CASE WHEN unreviewed > 0 THEN 'unreviewed' WHEN rejected > 0.1 * sampled THEN 'withheld' ELSE 'shipped' END AS state FROM a",
    "import_outcomes": """WITH o AS (SELECT o_orderkey AS id, o_custkey AS c FROM orders),
f AS (SELECT id, c % 3 = 0 AS modified, c % 2 = 0 AS here, c % 5 < 3 AS comes, c % 7 = 0 AS gone, c % 14 = 7 AS back FROM o)
SELECT id, CASE WHEN NOT comes THEN CASE WHEN modified THEN 'keptModified' ELSE 'removed' END WHEN gone AND NOT back THEN 'previouslyDeleted' WHEN here THEN CASE WHEN modified THEN 'keptModified' ELSE 'updated' END WHEN back THEN 'restored' ELSE 'added' END AS outcome FROM f WHERE here OR comes""",
    "revision_changes": "SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'new' WHEN c_custkey % 5 = 0 THEN 'removed' WHEN c_custkey % 7 = 0 AND upper(c_name) <> c_name THEN 'changed' ELSE 'kept' END AS status FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 5 <> 0",
    "reprint_sources": f"WITH {_LINKS} SELECT source, count(DISTINCT item_id) AS items, min(doc_id) AS least_doc, count(DISTINCT item_id) >= 0.25 * (SELECT count(DISTINCT item_id) FROM links) AS reprint FROM links JOIN documents USING (doc_id) GROUP BY source",
    "span_overlaps": f"WITH {_SPANS} SELECT a.node, count(*) AS pairs FROM s a JOIN s b ON a.node = b.node AND a.line % 2 = 0 AND b.line % 2 = 1 AND least(a.\"end\", b.\"end\") > greatest(a.start, b.start) GROUP BY a.node",
    "free_spans": f"WITH {_SPANS} SELECT * FROM s a WHERE line % 2 = 0 AND NOT EXISTS (SELECT 1 FROM s b WHERE b.node = a.node AND b.line % 2 = 1 AND least(a.\"end\", b.\"end\") > greatest(a.start, b.start))",
    "hidden_spans": f"""WITH {_SPANS}, n AS (SELECT node, min(start) AS start, max("end") AS "end" FROM s WHERE line = 1 GROUP BY node), h AS (SELECT s.node, s.start, s."end", n.node IS NOT NULL AND s.start <= n."end" AND n.start <= s."end" AS t FROM s LEFT JOIN n USING (node) WHERE s.line > 1)
SELECT node, start, "end" FROM h WHERE NOT t UNION ALL SELECT node, min(start) AS start, max("end") AS "end" FROM (SELECT node, start, "end" FROM h WHERE t UNION ALL SELECT node, start, "end" FROM n) GROUP BY node""",
    "restored_spans": f"""WITH {_SPANS}, n AS (SELECT node, min(start) AS start, max("end") AS "end" FROM s WHERE line = 1 GROUP BY node), h AS (SELECT s.node, s.start, s."end", coalesce(n.start, -1) AS a, coalesce(n."end", -1) AS b FROM s LEFT JOIN n USING (node) WHERE s.line > 1)
SELECT node, start, "end" FROM h WHERE b <= start OR "end" <= a UNION ALL SELECT node, start, a FROM h WHERE b > start AND "end" > a AND start < a UNION ALL SELECT node, b, "end" FROM h WHERE b > start AND "end" > a AND b < "end" """,
    "span_segments": f"""WITH {_SPANS}, e AS (SELECT DISTINCT node, unnest([start, "end"]) AS a FROM s), g AS (SELECT node, a, lead(a) OVER (PARTITION BY node ORDER BY a) AS b FROM e)
SELECT g.node, a AS start, b AS "end", count(*) AS layers FROM g JOIN s ON s.node = g.node AND s.start <= a AND s."end" >= b GROUP BY ALL""",
    "covered_nodes": f"WITH {_SPANS}, n AS (SELECT DISTINCT node FROM s), p AS (SELECT node, unnest(range(0, 30)) AS x FROM n) SELECT node, bool_and(EXISTS (SELECT 1 FROM s WHERE s.node = p.node AND s.start - 20 <= x AND x < s.\"end\")) AS covered FROM p GROUP BY node",
    "upper_median": "SELECT l_orderkey, list_sort(list(l_quantity))[count(*) // 2 + 1]::DOUBLE AS median FROM lineitem GROUP BY l_orderkey",
    "page_links": "SELECT page_id, coalesce(regexp_matches(url, '^(?i:https?)://'), false) AS safe, trim(regexp_replace(lower(regexp_replace(url, '^.*://', '')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages",
    "rare_trigrams": f"WITH d AS (SELECT DISTINCT id, gram FROM {_grams(3, 'doc_id AS id, text FROM documents')}), k AS (SELECT gram, count(DISTINCT id) AS df FROM {_grams(3, 'item_id AS id, text FROM benchmark')} GROUP BY gram) SELECT id AS doc_id, round(sum(1 / df), 6) AS weight, count(*) AS grams FROM d JOIN k USING (gram) GROUP BY id",
    "recurrence_labels": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) SELECT conv_id, turn, role || CASE WHEN n > 1 THEN chr((96 + n)::INT) ELSE '' END AS role FROM r",
    "next_shown": "SELECT a.conv_id, a.turn, coalesce((SELECT min(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn >= a.turn AND b.role = 'user'), (SELECT max(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.role = 'user')) AS shown FROM conversations a",
    "nearest_lines": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(l_quantity - 25), l_linenumber, l_quantity) <= 2",
    "clear_leads": "SELECT l_orderkey, arg_max(l_linenumber, l_quantity) AS l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey HAVING count(*) = 1 OR list_reverse_sort(list(l_quantity))[1] - list_reverse_sort(list(l_quantity))[2] > 8",
    "lines_in_reach": "SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS other FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND abs(a.l_quantity - b.l_quantity) <= 5",
    "conversation_hash": "SELECT conv_id, sha256(string_agg(turn || chr(9) || coalesce(text, '') || chr(10), '' ORDER BY turn))[1:16] AS revision FROM conversations GROUP BY conv_id",
    "collection_counts": "SELECT n_nationkey, n_name, count(*) FILTER (c_mktsegment = 'BUILDING') AS own, count(*) FILTER (c_mktsegment <> 'BUILDING') AS imported FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY ALL",
    "edit_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER o <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM r GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id",
}
