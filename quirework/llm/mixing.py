"""Mixing sources to target weights by entropy balancing; DataFrame functions only.

Documents get the rates of copies, ``most`` at most, that stay closest to one copy each in relative entropy
while every source's expected words equal its target. The solution tilts each document exponentially by what
it adds to its source's constraint: a document of ``c`` words has the rate ``min(most, exp(lambda * c))`` with
its source's multiplier ``lambda``. The multipliers maximise the concave dual by Newton steps: the cluster
counts documents of equal size together, and of each source's counts a task sums gradient and curvature and moves
the multiplier, halving the known bracket where a step would leave it, until the gradient is below ``1e-12`` of
the source's words. Multipliers stay in a table, a row a source; sources are counted once, to tell whether a table
of them is broadcast.

Rates are rounded into copies: every document takes the whole part of its rate, and the fractions are met
by one more copy of documents in the order of a uniform hash over the fraction (sequential Poisson sampling,
so that a document's chance of it is its fraction) until the source's words are reached; then of the
documents left with a fraction, the one whose size is nearest to what is missing joins if that helps. The
place where the target falls is found by a histogram of that order per source, so only documents of one
step are ranked, rows alike being counted together, and no source is brought together in a task.

Null texts have size 0; the null source is a source, last in order. Documents of size 0 take 0
words. The hash is of id and text; of rows alike in id, text and source, as many take a copy more as are
needed. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small, words

#: Steps of the sampling order that a histogram tells apart below 1, and the last step.
STEPS, LAST = 4096, 16384
_ROUNDS = 200
#: Sources up to which a table of them is broadcast.
_FEW = 100_000


def size(text: Column) -> Column:
    """How many words a text has."""
    return F.size(words(text)).cast("long")


def ranked(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``place``, each source's place by code point from 0, nulls last; sorted in ranges, of which only the counts are brought together."""
    parts = cut(sizes.orderBy(F.col("source").asc_nulls_last())).withColumn("range", F.spark_partition_id())
    before = parts.groupBy("range").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    return parts.withColumn("own", own).join(F.broadcast(before.select("range", "before")), "range").select(*sizes.columns, (F.col("before") + F.col("own") - 1).alias("place"))


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """``sizes`` (``source``, ``source_size``) with ``target``.

    Sources by code point, nulls last, weigh ``weights`` in turn and share ``share`` of all sizes;
    whatever exceeds ``most`` times a source's size is shared by weight among the others. The level by
    weight rises until no further source is full; each round sums once over the sources.
    """
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    weighed = cut(ranked(sizes).select("source", "source_size", turn.alias("w"), (F.col("source_size") * most).alias("full")))
    goal = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1
    while True:
        open_ = F.col("full") > level * F.col("w")
        rest, w, n = weighed.agg(F.sum(F.when(~open_, F.col("full"))), F.sum(F.when(open_, F.col("w"))), F.count_if(open_)).first()
        if n == before or not w:
            break
        level, before = max(level, (goal * share - (rest or 0.0)) / w), n
    return weighed.select("source", "source_size", F.least("full", F.col("w") * level).alias("target"))


def tilts(targeted: DataFrame, spectrum: DataFrame, most: float = 2.0) -> DataFrame:
    """``targeted`` with ``tilt``: the multipliers that Newton steps on the dual settle on; null where the target leaves no choice.

    ``spectrum`` has ``source``, ``size`` and ``n``, how many documents of a source have that size. A source is solved in a row
    of its own, whose arrays are short: ``k`` distinct sizes take ``k * k / 2`` words at least.
    """
    few = small(targeted, _FEW)
    # at most times its size a source takes all, at 0 nothing
    able = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * most * (1 - 1e-12))
    listed = spectrum.where("size > 0").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("size", "n"))).alias("listed"))
    told = _with(listed, targeted.where(able), few=few).select("source", "listed", F.col("source_size").alias("words"), "target")
    told = told.withColumn("mean", F.aggregate("listed", F.lit(0.0), lambda a, s: a + s["n"] * s["size"] * s["size"]) / F.col("words"))
    return _with(targeted, told.select("source", _tilt(most).alias("tilt")), "left", few=few)


def _tilt(most: float) -> Column:
    """The multiplier with which the documents of ``listed`` (``size`` and how many, ``n``), of ``words`` words in all, come to ``target`` expected words."""
    words, target, mean, none = F.col("words"), F.col("target"), F.col("mean"), F.lit(None).cast("double")

    def sums(x: Column) -> Column:
        """Expected words at ``x`` and their slope."""

        def add(a: Column, s: Column) -> Column:
            mass, tilt = s["n"] * s["size"], F.exp(x * s["size"])
            return F.struct((a["g"] + mass * F.least(F.lit(most), tilt)).alias("g"), (a["slope"] + F.when(tilt < most, mass * s["size"] * tilt).otherwise(0.0)).alias("slope"))

        return F.aggregate("listed", F.struct(F.lit(0.0).alias("g"), F.lit(0.0).alias("slope")), add)

    def moved(at: Column, v: Column) -> Column:
        x, g, slope = at["x"], v["g"], v["slope"]
        lo, hi = F.when(g <= target, x).otherwise(at["lo"]), F.when(g >= target, x).otherwise(at["hi"])
        # a step on the logarithm of the expected words, which is nearer to a line than they are
        step = F.when((slope > 0) & (g > 0), x - F.log(g / target) * g / slope)
        # the bracket grows until it holds the solution
        wider = F.when(hi.isNull(), lo + at["reach"]).when(lo.isNull(), hi - at["reach"]).otherwise((lo + hi) / 2)
        inside = step.isNotNull() & (lo.isNull() | (step > lo)) & (hi.isNull() | (step < hi))
        settled = (F.abs(g - target) <= words * 1e-12) | F.coalesce(hi - lo <= F.abs(x) * 4e-16, F.lit(False))
        return F.struct(F.when(settled, x).when(inside, step).otherwise(wider).alias("x"), lo.alias("lo"), hi.alias("hi"), (at["reach"] * 2).alias("reach"), settled.alias("done"))

    start = F.struct((F.log(target / words) / mean).alias("x"), none.alias("lo"), none.alias("hi"), (1 / mean).alias("reach"), F.lit(False).alias("done"))
    # the sums of a step are told once, as the only element of an array
    step = lambda at, _: F.when(at["done"], at).otherwise(F.transform(F.array(sums(at["x"])), lambda v: moved(at, v))[0])
    open_ = F.raise_error(f"the dual did not settle in {_ROUNDS} rounds").cast("double")
    return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), start, step, lambda at: F.when(at["done"], at["x"]).otherwise(open_))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: float = 2.0) -> DataFrame:
    """``(id_col, source, size, source_size, target, rate, copies, taken)`` for each row of ``docs``."""
    key = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit(""))).cast("binary"))
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size(F.col(text_col)).alias("size"), key.alias("h")))
    spectrum = cut(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    per_source = spectrum.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = cut(targets(per_source, most=most))
    few = small(goals, _FEW)
    tilted = cut(tilts(goals, spectrum, most))
    full = F.when((F.col("target") > 0) & (F.col("source_size") > 0), most).otherwise(0.0)
    rate = F.when(F.col("tilt").isNull(), full).otherwise(F.round(F.least(F.lit(most), F.exp(F.col("tilt") * F.col("size"))), 9))
    u = F.conv(F.substring("h", 1, 13), 16, 10).cast("double") / float(1 << 52)
    rows = _with(rows, tilted, few=few).withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
    # the sampling order, null for rows that take no fraction
    rows = rows.withColumn("order", F.when((F.col("part") > 0) & (F.col("size") > 0), u / F.col("part")))
    rows = rows.withColumn("step", F.when(F.col("order").isNotNull(), F.least(F.floor(F.col("order") * STEPS), F.lit(LAST)).cast("int"))).drop("part", "tilt")

    whole = rows.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("sure"))
    parts = cut(rows.where("step is not null").groupBy("source", "step").agg(F.sum("size").alias("n")))
    missing = F.when(F.col("tilt").isNotNull(), F.col("target") - F.col("sure")).otherwise(0.0)
    rated = cut(_with(tilted, whole, few=few).select("source", missing.alias("missing")))
    # the step in which the missing words are reached, and the words of the steps before it
    so_far = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    edge = _with(parts.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0))), rated, few=few)
    edge = edge.where("before + n > missing").groupBy("source").agg(F.min(F.struct("step", "before")).alias("at")).select("source", F.col("at.step").alias("edge"), "at.before")
    total = parts.groupBy("source").agg(F.sum("n").alias("all"))
    planned = cut(_with(_with(rated, edge, "left", few), total, "left", few=few).select("source", "missing", F.coalesce("edge", F.lit(LAST + 1)).alias("edge"), F.coalesce("before", "all", F.lit(0)).alias("before")))
    # inside that step rows alike are one, and the first that does not fit whole gives as many of its rows as fit
    inside = _with(rows.where("step is not null"), planned, few=few).where("step = edge").groupBy("source", "missing", "before", "order", "h", "size").agg(F.count("*").alias("m"))
    upto = Window.partitionBy("source").orderBy("order", "h")
    inside = cut(inside.withColumn("upto", F.col("before") + F.sum(F.col("m") * F.col("size")).over(upto)))
    fitting = inside.where("upto <= missing").groupBy("source").agg(F.max(F.struct("upto", "order", "h")).alias("last"))
    following = inside.where("upto > missing").groupBy("source").agg(F.min(F.struct("order", "h", "m", "size", "upto")).alias("next"))
    ends = _with(_with(planned, fitting, "left", few), following, "left", few=few)
    some = F.when(F.col("next").isNotNull(), F.floor((F.col("missing") - (F.col("next.upto") - F.col("next.m") * F.col("next.size"))) / F.col("next.size"))).otherwise(0)
    taken = F.coalesce("last.upto", "before") + some * F.coalesce("next.size", F.lit(0))
    ends = cut(ends.select("source", "edge", F.col("last.order").alias("last_order"), F.col("last.h").alias("last_h"), F.when(some > 0, F.col("next.h")).alias("some_h"), some.alias("some"), (F.col("missing") - taken).alias("left")))
    rows = _with(rows, ends, few=few)
    first = F.coalesce((F.col("step") < F.col("edge")) | (F.col("step") == F.col("edge")) & ((F.col("order") < F.col("last_order")) | (F.col("order") == F.col("last_order")) & (F.col("h") <= F.col("last_h"))), F.lit(False))
    apart = F.abs(F.col("left") - F.col("size"))
    # a row of the group that gave some may close too, if one is left; the choice is by hash among sizes as near
    closing = rows.where(~first & F.col("step").isNotNull() & (apart < F.col("left"))).groupBy("source", "h", "some_h", "some").agg(F.count("*").alias("m"), F.min(apart).alias("d"))
    closing = closing.where(~F.coalesce(F.col("h") == F.col("some_h"), F.lit(False)) | (F.col("m") > F.col("some"))).groupBy("source").agg(F.min(F.struct("d", "h")).getField("h").alias("close_h"))
    closed = cut(_with(ends.select("source", "some_h", "some"), closing, "left", few=few))
    picks = closed.select("source", F.explode(F.array(F.struct(F.col("some_h").alias("h"), F.col("some").alias("e")), F.struct(F.col("close_h").alias("h"), F.lit(1).cast("long").alias("e")))).alias("p")).where("p.h is not null").groupBy("source", "p.h").agg(F.sum("p.e").alias("e"))
    picks = cut(picks.select(F.col("source").alias("_source"), F.col("h").alias("_h"), "e"))
    chosen = F.broadcast(picks) if small(picks, 100_000) else picks
    on = F.col("source").eqNullSafe(F.col("_source")) & (F.col("h") == F.col("_h"))
    marked = rows.withColumn("first", first).join(chosen, on, "left").drop("_source", "_h")
    # rows alike are numbered within their tasks, and the tasks' counts give where each task begins
    alike = cut(marked.where("e is not null").withColumn("task", F.spark_partition_id()))
    begins = alike.groupBy("source", "h", "task").count().withColumn("begin", F.coalesce(F.sum("count").over(Window.partitionBy("source", "h").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    begins = begins.select(F.col("source").alias("_source"), F.col("h").alias("_h"), F.col("task").alias("_task"), "begin")
    number = F.row_number().over(Window.partitionBy("source", "h", "task").orderBy("size"))
    numbered = alike.withColumn("number", number).join(begins, on & (F.col("task") == F.col("_task"))).withColumn("first", F.col("number") + F.col("begin") <= F.col("e"))
    columns = ["id", "source", "size", "source_size", "target", "rate", "whole", "first"]
    done = marked.where("e is null").select(*columns).unionByName(numbered.select(*columns))
    copies = (F.col("whole") + F.col("first").cast("long")).cast("long")
    return done.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _with(rows: DataFrame, per_source: DataFrame, how: str = "inner", few: bool = False) -> DataFrame:
    """``rows`` with the columns of a table of one row a source, which is broadcast if there are ``few`` sources."""
    named = per_source.drop(*[c for c in per_source.columns if c in rows.columns and c != "source"]).withColumnRenamed("source", "_source")
    named = F.broadcast(named) if few else named
    return rows.join(named, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")
