"""The subpackage's queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, licenses, merkle, mixing, quality, recipes, resample, rules, simhash, toxicity, url_rules, warc
from .common import cut, fold, shared_folder, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold("doc_id", 5) == 0
    model = toxicity.fit(docs, labels.where(~held))
    scored = docs.select("doc_id", held.alias("held_out"), toxicity.score_column(docs, model, F.col("text")).alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", F.col("covered").cast("int").alias("covered"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "copies", "taken")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 5) == 0
    model = langid.fit(docs.where(~held))
    return docs.select("doc_id", held.alias("held_out"), langid.predict_column(docs, model, F.col("text")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), folder)
    told = warc.read(spark, folder)
    return told.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold("doc_id", 4) == 2
    stats = cut(docs.select("doc_id", quality.statistics_column(F.col("text")).alias("x")))
    model = quality.fit(stats, labels.where(~held), "doc_id")
    scored = stats.select("doc_id", held.alias("held_out"), quality.score_column(stats, model, F.col("x")).alias("score"))
    return scored.select("*", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op11_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [merkle.lowered(F.col(c)) if c == "text" else F.col(c) for c in merkle.FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.leaf(*fields))
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered).drop("source")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_decontamination, op3_mixing, op4_language_id, op5_url_rules, op6_warc, op7_quality, op8_quality_rules, op9_licenses, op10_simhash, op11_recipes, op12_resampling, op13_manifest)}


def _licence_sql() -> str:
    """Sentences of each document by unnesting, and rules as joins of sentence places."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(licenses.normalised(s))}, {quote(k)})" for k, s in licenses.SENTENCES.items())
    picks = []
    for name, ids in licenses.RULES:
        longer = [o for n, o in licenses.RULES if n == name and len(o) > len(ids) and set(ids) <= set(o)]
        picks.append((name, ids, longer))

    def exists(ids: tuple[str, ...]) -> str:
        tables = ", ".join(f"hits h{i}" for i in range(len(ids)))
        on = " AND ".join([f"h{i}.doc_id = n.doc_id AND h{i}.id = {quote(x)}" for i, x in enumerate(ids)] + [f"h{i}.pos < h{i + 1}.pos" for i in range(len(ids) - 1)])
        return f"EXISTS (SELECT 1 FROM {tables} WHERE {on})"

    selects = " UNION ALL ".join(f"SELECT doc_id, {quote(name)} AS licence, {quote(' '.join(ids))} AS rule, sentences FROM n WHERE {exists(ids)}" + "".join(f" AND NOT {exists(o)}" for o in longer) for name, ids, longer in picks)
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
lines AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\r?\\n')) AS line, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\\r?\\n'), 1) AS l FROM documents),
cut AS (SELECT doc_id, l, regexp_split_to_array(regexp_replace(line, '([.!?])[ \\t]+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM lines),
sentences AS (SELECT doc_id, l * 100000 + generate_subscripts(parts, 1) AS pos, unnest(parts) AS s FROM cut),
clean AS (SELECT doc_id, pos, trim(regexp_replace(regexp_replace(lower(s), '[^a-z0-9.-]+', ' ', 'g'), '\\.+( |$)|^[ .-]+|[ .-]+$', '\\1', 'g')) AS s FROM sentences),
hits AS (SELECT doc_id, pos, id FROM clean JOIN known ON trim(s) = sentence),
n AS (SELECT doc_id, count(*)::INT AS sentences FROM hits GROUP BY doc_id),
met AS ({selects})
SELECT * FROM met WHERE licence NOT IN ({', '.join(map(quote, licenses.ALONE))}) OR doc_id NOT IN (SELECT doc_id FROM met WHERE licence NOT IN ({', '.join(map(quote, licenses.ALONE))}))"""


def _mixing_sql(halvings: int = 70) -> str:
    """The multipliers by halving a bracket as often as doubles allow, then running sums over all rows in the sampling order."""
    start = "l0 AS (SELECT source, target, -1.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM t WHERE target > 0 AND target < 2.0 * source_size * (1 - 1e-12))"
    step = lambda k: f"l{k} AS (SELECT l.source, target, CASE WHEN g <= target THEN (lo + hi) / 2 ELSE lo END AS lo, CASE WHEN g <= target THEN hi ELSE (lo + hi) / 2 END AS hi FROM l{k - 1} l JOIN (SELECT a.source, sum(n * size * least(2.0, exp(least(50, (lo + hi) / 2 * size)))) AS g FROM l{k - 1} a JOIN spectrum b ON a.source IS NOT DISTINCT FROM b.source GROUP BY a.source) s ON l.source IS NOT DISTINCT FROM s.source)"
    bracket = ",\n".join([start, *map(step, range(1, halvings + 1))])
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(md5(text), '')) AS h FROM documents),
spectrum AS MATERIALIZED (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY ALL),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s),
tried AS (SELECT a.source AS a_source, 2.0 * a.source_size / a.w AS level, sum(least(2.0 * b.source_size, b.w * 2.0 * a.source_size / a.w)) AS total FROM w a, w b GROUP BY ALL),
goal AS (SELECT 1.5 * sum(source_size) AS goal FROM s),
lo AS (SELECT coalesce(max(level), 0) AS level FROM tried, goal WHERE total <= goal),
lvl AS (SELECT lo.level + coalesce((goal - sum(least(2.0 * source_size, w * lo.level))) / nullif(sum(CASE WHEN 2.0 * source_size / w > lo.level + 1e-9 THEN w END), 0), 0) AS level FROM w, lo, goal GROUP BY lo.level, goal),
t AS MATERIALIZED (SELECT source, source_size, least(2.0 * source_size, w * level) AS target FROM w, lvl),
{bracket.replace("AS (SELECT l.source", "AS MATERIALIZED (SELECT l.source")},
r AS (SELECT d.*, source_size, t.target, CASE WHEN l.source IS NULL AND l.lo IS NULL THEN CASE WHEN t.target > 0 THEN 2.0 ELSE 0 END ELSE round(least(2.0, exp(least(50, lo * size))), 9) END AS rate, l.lo IS NOT NULL AS open FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN l{halvings} l ON d.source IS NOT DISTINCT FROM l.source),
o AS (SELECT *, floor(rate) AS whole, CASE WHEN rate > floor(rate) AND size > 0 THEN ('0x' || h[1:13])::BIGINT / 4503599627370496.0 / (rate - floor(rate)) END AS ord FROM r),
m AS (SELECT source, CASE WHEN any_value(open) THEN any_value(target) - sum(whole * size) ELSE 0 END AS missing FROM o GROUP BY source),
p AS (SELECT o.*, missing, sum(size) OVER (PARTITION BY o.source ORDER BY ord, h ROWS UNBOUNDED PRECEDING) AS upto FROM o JOIN m ON o.source IS NOT DISTINCT FROM m.source WHERE ord IS NOT NULL),
rest AS (SELECT source, any_value(missing) - coalesce(max(upto) FILTER (upto <= missing), 0) AS rest FROM p GROUP BY source),
c AS (SELECT p.source, arg_min(h, (abs(rest - size), h)) AS closing FROM p JOIN rest ON p.source IS NOT DISTINCT FROM rest.source WHERE upto > missing AND abs(rest - size) < rest GROUP BY p.source),
e AS (SELECT p.source, p.h, upto <= missing OR coalesce(p.h = closing, false) AS more FROM p LEFT JOIN c ON p.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, (whole + coalesce(more, false)::INT)::BIGINT AS copies, (whole + coalesce(more, false)::INT)::BIGINT * size AS taken
FROM o LEFT JOIN e ON o.source IS NOT DISTINCT FROM e.source AND o.h = e.h"""


#: CRC-32 of a blob, a byte at a time through the table that its polynomial gives.
_CRC = "xor(4294967295, list_reduce(list_transform(range(1, 1 + octet_length(b)), lambda i: ('0x' || substr(hex(b), 2 * i - 1, 2))::BIGINT), lambda crc, x: xor(crc >> 8, divided[1 + (xor(crc, x) & 255)]), 4294967295))"


def _bits(n: int) -> str:
    """``n`` steps of the checksum's division on a list of numbers."""
    return "range(0, 256)" if n == 0 else f"list_transform({_bits(n - 1)}, lambda c: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"


_RESAMPLING = f"""
WITH crc_table AS MATERIALIZED (SELECT {_bits(8)}::BIGINT[] AS divided),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
i AS (SELECT list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
raw AS MATERIALIZED (SELECT doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1]), list_transform(range(1, len(ws) - 1), lambda k: ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2]))) AS f FROM d),
aim AS MATERIALIZED (SELECT unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1]), list_transform(range(1, len(ws) - 1), lambda k: ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2]))) AS f FROM i),
told AS (SELECT f, encode(f) AS b FROM (SELECT f FROM raw UNION SELECT f FROM aim)),
bucket AS MATERIALIZED (SELECT f, {_CRC} % 10000 AS k FROM told, crc_table),
s AS (SELECT k, count(*) AS s FROM raw JOIN bucket USING (f) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM aim JOIN bucket USING (f) GROUP BY k),
gain AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (k)),
w AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM raw JOIN bucket USING (f) JOIN gain USING (k) GROUP BY doc_id),
scored AS (SELECT doc_id, len(ws) AS n, (len(ws) + greatest(len(ws) - 1, 0) + greatest(len(ws) - 2, 0))::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (doc_id)),
ranked AS (SELECT *, CASE WHEN n >= 20 THEN row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) END AS r FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 5 * (SELECT count(*) FROM scored WHERE n >= 20) // 100 THEN r END AS rank FROM ranked"""


def _merkle_sql(deep: int = 5, wide: int = 3) -> str:
    """Trees of up to 16^deep leaves a source and 16^wide sources, a level a step; finished trees pass."""
    field = lambda x: f"coalesce(octet_length(encode({x}::VARCHAR)) || ':' || {x}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    runs = lambda a, k: f"{a}r{k} AS MATERIALIZED (SELECT tree, i // 16 AS p, any_value(n) AS n, list(node ORDER BY i) AS run FROM {a}{k} GROUP BY tree, i // 16)"
    up = lambda a, k: f"{a}{k + 1} AS MATERIALIZED (SELECT tree, p AS i, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS node FROM {a}r{k})"
    rest = "list_concat(run[1:i % 16], run[i % 16 + 2:])"
    walk = lambda a, k, at: f"w{at + 1} AS MATERIALIZED (SELECT doc_id, leaf, subroot, w.tree, i // 16 AS i, forest_i, proof || CASE WHEN n > 1 THEN array_to_string({rest}, '') ELSE '' END AS proof, CASE WHEN n > 1 THEN sha256(array_to_string(list_concat(run[1:i % 16], [node], run[i % 16 + 2:]), '')) ELSE node END AS node FROM w{at} w JOIN {a}r{k} r ON w.tree = r.tree AND i // 16 = p)"
    steps = [s for k in range(deep) for s in (runs("t", k), up("t", k))]
    steps.append(f"f0 AS MATERIALIZED (SELECT '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n, node, tree AS own FROM t{deep})")
    steps += [s for k in range(wide) for s in (runs("f", k), up("f", k))]
    steps.append("w0 AS (SELECT doc_id, leaf, f0.node AS subroot, l.tree, l.i, f0.i AS forest_i, '' AS proof, told AS node FROM l JOIN f0 ON l.tree = f0.own)")
    steps += [walk("t", k, k) for k in range(deep)]
    steps.append(f"w{deep + 1} AS (SELECT doc_id, leaf, subroot, '' AS tree, forest_i AS i, forest_i, proof, node FROM w{deep})")
    steps += [walk("f", k, deep + 1 + k) for k in range(wide)]
    return f"""
WITH crc_table AS MATERIALIZED (SELECT {_bits(8)}::BIGINT[] AS divided),
c AS (SELECT *, encode(doc_id::VARCHAR) AS b FROM documents, crc_table),
a AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS tree, {leaf("text")} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {leaf("text")} END AS told FROM c),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM a),
t0 AS (SELECT tree, i, n, leaf AS node FROM l),
{(","+chr(10)).join(steps)}
SELECT doc_id, leaf, subroot, f{wide}.node AS root, sha256(proof) AS proof_sha256, w.node AS folded_root, w.node = f{wide}.node AS verified FROM w{deep + 1 + wide} w JOIN f{wide} ON true"""


ORACLE = {
    "op11_recipes": """
WITH d AS (SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS plain FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY plain ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM g""",
    "op12_resampling": _RESAMPLING,
    "op13_manifest": _merkle_sql(),
    "op2_decontamination": """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws FROM documents),
i AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws FROM benchmark),
dt AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
it AS (SELECT item_id, len(ws) AS m, unnest(ws) AS w, generate_subscripts(ws, 1) AS q FROM i WHERE len(ws) >= 5),
eq AS (SELECT doc_id, item_id, m, p - q AS diag, q FROM dt JOIN it USING (w)),
dense AS (SELECT doc_id, item_id, diag FROM eq GROUP BY ALL HAVING count(*) >= CASE WHEN any_value(m) >= 13 THEN 11 WHEN any_value(m) >= 10 THEN any_value(m) - 1 ELSE any_value(m) END),
near AS (SELECT * FROM eq SEMI JOIN dense USING (doc_id, item_id, diag)),
starts AS (SELECT doc_id, item_id, diag, m, unnest(range(greatest(1, q - least(13, m) + 1), least(q, m - least(13, m) + 1) + 1)) AS s FROM near),
good AS (SELECT doc_id, item_id, m, s FROM starts GROUP BY doc_id, item_id, diag, m, s HAVING count(*) >= CASE WHEN m >= 13 THEN 11 WHEN m >= 10 THEN m - 1 ELSE m END),
alone AS (SELECT doc_id, item_id, len(i.ws) AS m, unnest(range(1, len(i.ws) + 1)) AS q FROM d JOIN i ON d.ws = i.ws WHERE len(i.ws) BETWEEN 1 AND 4),
covered AS (SELECT DISTINCT doc_id, item_id, m, unnest(range(s, s + least(13, m))) AS q FROM good UNION SELECT * FROM alone)
SELECT doc_id, item_id, m::INT AS item_words, count(*)::INT AS covered FROM covered GROUP BY ALL""",
    "op3_mixing": _mixing_sql(),
    "op6_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
f AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS hex, min(page_id) OVER (PARTITION BY b) AS first FROM p),
g AS (SELECT *, list_transform(range(0, 32), lambda i: (('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (5 * (3 - i % 4))) & 31) AS digits FROM f)
SELECT page_id, payload_bytes, list_aggregate(list_transform(digits, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + x::INT, 1)), 'string_agg', '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM g""",
    "op9_licenses": _licence_sql(),
}
