"""URL filtering by association rules; DataFrame functions and Spark's FP-growth only.

Explicit rules come first: a rule (host and path) fits its host and all subdomains if the url's
path starts with the rule's path, and the longest fitting rule decides. The urls they decide are
the labelled transactions: FP-growth mines combinations of url tokens and verdicts, and rules from
tokens to a verdict are kept above a least support and confidence, unless a shorter rule inside them
is as sure. The rules form an inverted index from tokens; a url fires a rule when it has all of its
tokens, and the surest (then best supported, longest, first by text) fired rule decides. Urls that
fire nothing are allowed.

Tokens are the host's labels and suffixes, path segments, query names and the file extension; runs
of digits read as 0. Null urls and urls without ``://`` have empty host and path and no tokens.
Repeated urls are judged once and alike. Empty tables, and pages of which no explicit rule decides
any, give no mined rules.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small

#: The explicit rules of the production filter: verdict, host, path. Fixed values.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MINED = T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("verdict", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("support", T.DoubleType())])


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, F.translate(host, _UPPER, _LOWER)).otherwise(""), F.when(has, path).otherwise("")


def explicit(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; nulls where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """A url's distinct tokens, marked by where they stand."""
    zero = lambda c: F.regexp_replace(c, r"\d+", "0")
    labels = F.split(host, r"\.")
    after = lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")
    suffixes = F.transform(F.sequence(F.lit(0), F.size(labels) - 1), lambda i: F.concat(F.lit("host:"), zero(after(i))))
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.concat(F.lit("path:"), zero(s)))
    query = F.regexp_extract(F.substring_index(url, "#", 1), r"(?s)\?(.*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("query:"), zero(F.substring_index(s, "=", 1))))
    kind = F.concat(F.lit("ext:"), F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1))
    found = F.concat(suffixes, segments, names, F.array(kind))
    return F.when(host != "", F.array_distinct(F.filter(found, lambda t: ~t.isin("ext:", "host:")))).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, support: float = 0.002, confidence: float = 0.9) -> DataFrame:
    """``tokens``, ``verdict``, ``confidence``, ``support`` of the pruned rules mined from ``labelled`` (``tokens``, ``verdict``).

    Single tokens are counted directly. Those of one verdict alone make every longer rule vain, so FP-growth
    mines the others, and of tokens that occur in the same urls it sees the first by text, as longer rules say
    the same of all; else a path of ``n`` segments that many urls share would give ``2**n`` itemsets.
    """
    spark = labelled.sparkSession
    n = labelled.count()
    if n == 0:
        return spark.createDataFrame([], _MINED)
    least = support * n
    alone = labelled.select("verdict", F.xxhash64("tokens").cast("decimal(38,0)").alias("basket"), F.explode("tokens").alias("token"))
    alone = alone.groupBy("token", "verdict").agg(F.count("*").alias("n"), F.sum("basket").alias("mark"))
    every = alone.groupBy("token").agg(F.sum("n").alias("all"), F.sum("mark").alias("mark"), F.max("n").alias("most")).where(F.col("all") >= least)
    every = cut(every)
    singles = alone.select("token", "verdict", "n").join(every.select("token", "all"), "token").where((F.col("n") >= least) & (F.col("n") >= confidence * F.col("all")))
    singles = singles.select(F.array("token").alias("tokens"), "verdict", (F.col("n") / F.col("all")).alias("confidence"), (F.col("n") / n).alias("support"))
    mixed = cut(every.where("most < all").groupBy("all", "mark").agg(F.min("token").alias("token")).select("token"))
    seen = labelled.withColumn("row", F.monotonically_increasing_id()).select("row", "verdict", F.explode("tokens").alias("token")).join(F.broadcast(mixed) if small(mixed, 100_000) else mixed, "token")
    baskets = seen.groupBy("row", "verdict").agg(F.collect_list("token").alias("tokens")).select(F.concat("tokens", F.array(F.concat(F.lit("verdict:"), "verdict"))).alias("items"))
    baskets = cut(baskets)
    found = singles
    if baskets.limit(1).count():
        share = min(1.0, least / baskets.count())
        model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(baskets)
        said = F.col("consequent")[0]
        longer = model.associationRules.where(said.startswith("verdict:") & (F.size("antecedent") > 1) & F.forall("antecedent", lambda t: ~t.startswith("verdict:")))
        found = found.unionByName(longer.select(F.array_sort("antecedent").alias("tokens"), F.substring_index(said, ":", -1).alias("verdict"), "confidence", (F.col("support") * baskets.count() / n).alias("support")))
    rules = cut(found)
    # a rule goes if leaving out one of its tokens gives a rule for the same verdict that is as sure
    shorter = rules.select("tokens", "verdict", F.col("confidence").alias("shorter"))
    less = rules.where(F.size("tokens") > 1).select("tokens", "verdict", "confidence", F.explode("tokens").alias("out"))
    less = less.select(F.col("tokens").alias("whole"), "verdict", "confidence", F.array_remove("tokens", F.col("out")).alias("tokens"))
    vain = less.join(shorter, ["tokens", "verdict"]).where("shorter >= confidence").select(F.col("whole").alias("tokens"), "verdict").distinct()
    return rules.join(vain, ["tokens", "verdict"], "left_anti")


def fired(urls: DataFrame, rules: DataFrame, key: str = "url") -> DataFrame:
    """``key`` and the mined ``verdict`` and ``confidence`` of the urls (distinct ``key``, ``tokens``) that fire a rule."""
    index = cut(rules.select("verdict", "confidence", "support", F.size("tokens").alias("n"), F.to_json("tokens").alias("rule"), F.explode("tokens").alias("token")))
    index = F.broadcast(index) if small(index, 100_000) else index
    met = urls.select(key, F.explode("tokens").alias("token")).join(index, "token")
    whole = met.groupBy(key, "rule", "verdict", "confidence", "support", "n").agg(F.count("*").alias("have")).where("have = n")
    best = F.min(F.struct(-F.col("confidence"), -F.col("support"), -F.col("n"), "rule", "verdict", "confidence")).alias("best")
    return whole.groupBy(key).agg(best).select(key, F.col("best.verdict").alias("verdict"), F.col("best.confidence").alias("confidence"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, support: float = 0.002, confidence: float = 0.9) -> DataFrame:
    """``(id_col, host, path, rule, verdict, confidence)`` for each row of ``pages``."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    host, path = parts(F.col("url"))
    split = rows.withColumn("host", host).withColumn("path", path)
    rule, verdict = explicit(F.col("host"), F.col("path"), rules)
    told = cut(split.withColumn("rule", rule).withColumn("told", verdict).withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path"))))
    mined = mine(told.where("told is not null").select("tokens", F.col("told").alias("verdict")), support, confidence)
    open_ = told.where("told is null and size(tokens) > 0").select(F.to_json(F.array_sort("tokens")).alias("basket"), "tokens").dropDuplicates(["basket"])
    said = cut(fired(open_, mined, "basket"))
    said = F.broadcast(said) if small(said, 50_000) else said
    basket = F.when(F.col("told").isNull(), F.to_json(F.array_sort("tokens")))
    joined = told.withColumn("basket", basket).join(said, "basket", "left")
    return joined.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("told", "verdict", F.lit("allow")).alias("verdict"), "confidence")
