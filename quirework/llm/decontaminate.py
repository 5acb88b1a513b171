"""Benchmark decontamination by spaced-seed hashing; DataFrame functions only.

Words are maximal runs of letters and digits, lower-cased. A mask names the offsets of the words
that are hashed and ignores those between. The mask below hits every 13-word window in which at most two
words were substituted, and every item of 10 to 12 words in which at most one was (a test tries all
placements), so no such overlap is missed. Seeds of benchmark items and of documents are joined by hash,
without the texts; only the documents that hit are then joined back, and the words about each hit compared
with the item's, without gaps. Hits with the same words about them are one, so the work grows with a text's
length however often it repeats itself. An overlap is a window of 13 item words of which 11 or more agree. Items of
10 to 12 words may have one word substituted, items of 5 to 9 must occur whole (below 8 words by a mask of
their whole length), and shorter items must be all that a document says.

Items' seeds are broadcast while there are at most ``most`` of them, and so are hits; beyond that the
joins shuffle narrow rows. Null and empty texts have no words and overlap nothing. Null item ids are kept
as an id. Repeated documents are judged alike; repeated items count once. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, small

#: Offsets of the hashed words. One mask of five words suffices for the guarantee above; of six, two are needed.
MASKS = ((0, 1, 3, 6, 7),)
WINDOW, AGREE, ONE_OFF, ALONE = 13, 11, 10, 5
_SPAN = 8
#: Words of a window before the mask that it holds, at most.
_AHEAD = WINDOW - _SPAN
_BROADCAST = 1_000_000


def hashed_words(text: Column) -> Column:
    """The hash of each word of a text."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(tokens, lambda w: F.xxhash64(w))


def seeds(h: Column, short: list[int], item: bool = False, beside: bool = False) -> Column:
    """``(at, seed)`` for every mask at every place of an array of word hashes, with ``near``, the words about it, if ``beside``.

    ``short`` has the lengths below the mask's span that items have; those are masks of whole runs. An
    item only has the seeds of its own length, and items below ``ALONE`` words only meet texts as short.
    """

    def of(n: int, mask: tuple[int, ...], able: Column) -> Column:
        last = F.size(h) - (mask[-1] + 1)
        places = F.when((last >= 0) & able, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        near = lambda i: [about(h, i).alias("near")] if beside else []
        return F.transform(places, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(n), *[F.get(h, i + k) for k in mask]).alias("seed"), *near(i)))

    whole = [of(-m, tuple(range(m)), F.size(h) == m if item or m < ALONE else F.lit(True)) for m in short]
    return F.concat(*[of(n, mask, F.lit(True)) for n, mask in enumerate(MASKS)], *whole)


def about(h: Column, at: Column) -> Column:
    """The words that a window with a mask at ``at`` may hold, as far as there are any: from ``_AHEAD`` before it on, nulls beyond the ends."""
    none = F.lit(None).cast("bigint")
    begin = F.greatest(at - _AHEAD, F.lit(0))
    end = F.least(at + WINDOW, F.size(h))
    return F.concat(F.array_repeat(none, begin - (at - _AHEAD)), F.slice(h, begin + 1, end - begin), F.array_repeat(none, at + WINDOW - end))


def agreeing_starts(near: Column, g: Column, at: Column) -> Column:
    """First item words of the agreeing windows that hold a hit at the item's place ``at``, by the words about both places."""
    m = F.size(g)
    agree = F.zip_with(near, about(g, at), lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0)))
    of = lambda first, wide: F.aggregate(F.slice(agree, first, wide), F.lit(0), lambda a, x: a + x)
    whole = F.when(of(F.greatest(_AHEAD + 1 - at, F.lit(1)), m) >= F.when(m >= ONE_OFF, m - 1).otherwise(m), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    starts = F.filter(F.sequence(F.greatest(at - _AHEAD, F.lit(0)), F.least(at, F.greatest(m - WINDOW, F.lit(0)))), lambda s: of(s - at + _AHEAD + 1, F.lit(WINDOW)) >= AGREE)
    return F.when(m < WINDOW, whole).otherwise(starts)


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most: int = _BROADCAST) -> DataFrame:
    """``(id_col, text_hash, item_col, item_words, covered)``: per document and item that overlap, how many of the item's words lie in agreeing windows."""
    known = items.select(F.col(item_col).alias("item"), hashed_words(F.col(item_text)).alias("g")).where(F.size("g") > 0).select("item", F.hash("g").alias("item_hash"), "g").distinct()
    known = cut(known)
    short = sorted(r[0] for r in known.select(F.size("g")).where(F.size("g") < _SPAN).distinct().collect())  # at most seven lengths
    hooks = cut(known.select("item", "item_hash", F.inline(seeds(F.col("g"), short, item=True))).withColumnRenamed("at", "item_at").distinct())
    few = small(hooks, most)
    wanted = hooks.select("seed").distinct()
    wanted = F.broadcast(wanted) if few else wanted
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), hashed_words(F.col(text_col)).alias("h"))
    placed = rows.where(F.size("h") > 0).select("id", "text_hash", F.explode(F.transform(seeds(F.col("h"), short), lambda s: s["seed"])).alias("seed"))
    some = cut(placed.join(wanted, "seed", "left_semi").select(F.col("id").alias("k"), F.col("text_hash").alias("k_hash")).distinct())
    some = F.broadcast(some) if small(some, most) else some
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    texts = texts.join(some, (F.col("text_hash") == F.col("k_hash")) & F.col("id").eqNullSafe(F.col("k"))).select("id", "text_hash", hashed_words(F.col("text")).alias("h"))
    # places alike in all the words about them are one, so that a text that repeats itself has no more of them than it has words
    places = texts.select("id", "text_hash", F.inline(seeds(F.col("h"), short, beside=True))).join(wanted, "seed", "left_semi").select("id", "text_hash", "seed", "near").distinct()
    whole = known.select(F.col("item").alias("i"), F.col("item_hash").alias("i_hash"), "g")
    met = places.join(F.broadcast(hooks) if few else hooks, "seed")
    met = met.join(F.broadcast(whole) if small(whole, most // 100) else whole, F.col("item").eqNullSafe(F.col("i")) & (F.col("item_hash") == F.col("i_hash")))
    verified = met.select("id", "text_hash", "item", "item_hash", F.size("g").alias("m"), F.explode(agreeing_starts(F.col("near"), F.col("g"), F.col("item_at"))).alias("start")).distinct()
    together = verified.groupBy("id", "text_hash", "item", "item_hash", "m").agg(F.collect_set("start").alias("starts"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.least(F.lit(WINDOW), F.col("m")) - 1)))))
    return together.select(F.col("id").alias(id_col), "text_hash", F.col("item").alias(item_col), F.col("m").alias("item_words"), covered.alias("covered"))


def remove(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = _BROADCAST) -> DataFrame:
    """``docs`` without the documents that overlap an item, its columns as they are."""
    key, text_hash = fresh(docs.columns, "_id"), fresh(docs.columns, "_hash")
    bad = cut(overlaps(docs, items, id_col, text_col, most=most).select(F.col(id_col).alias(key), F.col("text_hash").alias(text_hash)).distinct())
    bad = F.broadcast(bad) if small(bad, most) else bad
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(text_hash)), "left_anti")
