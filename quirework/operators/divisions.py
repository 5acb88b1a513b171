"""Scenes for versions that print fewer divisions than the version they are aligned to, or print them in another order.

A version's blocks have ``by`` (the text, or a scene of it), ``n`` (their turn from 0), ``words`` (array of word
keys) and ``entrance``; scenes of the divided version have ``by``, ``n`` and ``words``. Null arrays are empty and
a null ``entrance`` is none. What is gathered into an array or handed to a kernel is one text's blocks or runs.
Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays
from . import order, sequences

#: How many words nearer a plain block must begin to win over an entrance.
ENTRANCE = 40
#: Words beside a block that inform its label, the least words of a run, and how far off, in blocks and words, a run may begin at an entrance.
BESIDE, RUN, NEAR_BLOCKS, NEAR_WORDS = 60, 60, 6, 120
#: Weights are whole multiples of this part of 1, so that sums are exact and ties are ties.
_UNIT = 1 << 40


def _begun(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` with ``words`` not null, ``size`` and ``start``: the words before a row."""
    told = rows.withColumn("words", F.coalesce("words", F.array().cast("array<string>"))).withColumn("size", F.size("words"))
    return order.running_offset(told, by, "n", F.col("size"), "start").withColumn("start", F.col("start").cast("int"))


def landmarks(orig: Column, modern: Column, n: int = 5) -> Column:
    """Places (``orig``, ``modern``) of the n-grams of two arrays of words that occur once in each, those on a longest chain that rises on both."""

    def of(orig: pa.Scalar, modern: pa.Scalar) -> list[dict]:
        size = len(orig.values)
        code = arrays.codes(pa.concat_arrays([orig.values, modern.values]), n)
        # runs that reach from one side into the other are none
        sides = [code[: max(size - n + 1, 0)], code[size:]]
        once = [np.unique(side, return_index=True, return_counts=True) for side in sides]
        (own, at), (other, to) = [(c[k == 1], i[k == 1]) for c, i, k in once]
        _, i, j = np.intersect1d(own, other, assume_unique=True, return_indices=True)
        turn = np.argsort(to[j])
        pairs = np.stack([at[i], to[j]])[:, turn]
        return [{"orig": o, "modern": m} for o, m in pairs[:, sequences.rising(pairs[0].tolist())].T.tolist()]

    return arrays.by_row(of, pa.list_(pa.struct([("orig", pa.int32()), ("modern", pa.int32())])), "array<struct<orig:int,modern:int>>")(orig, modern)


def counterpart(at: Column, chain: Column) -> Column:
    """The place in ``orig`` that the pairs of a rising ``chain`` (``landmarks``) before and behind a place in ``modern`` give it, rounded half up.

    Behind the last pair, and before the first, places run in step; the first pair stands behind ``(0, 0)``.
    """
    start = F.struct(F.lit(0).alias("orig"), F.lit(0).alias("modern"))
    before = F.coalesce(F.try_element_at(F.filter(chain, lambda p: p["modern"] <= at), F.lit(-1)), start)
    after = F.try_element_at(F.filter(chain, lambda p: p["modern"] > at), F.lit(1))
    between = F.floor(before["orig"] + (at - before["modern"]) / (after["modern"] - before["modern"]) * (after["orig"] - before["orig"]) + 0.5)
    return F.when(after.isNull(), before["orig"] + at - before["modern"]).otherwise(between).cast("int")


def split(blocks: DataFrame, scenes: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by``, ``n``, ``piece``: each block with the number, from 0, of the scene of its ``by`` that it belongs to.

    A scene's first word is placed by the landmarks around it, and the scene begins with the block that begins
    nearest, an entrance counting ``ENTRANCE`` words nearer; it begins behind the block with which the scene
    before it begins. Where no block is left, the last scenes stay without. A text's blocks are a row and its
    scenes another, each moved once at most.
    """
    arrays.bounded(blocks.sparkSession)
    none = F.array().cast("array<array<string>>")
    words, entrance = F.coalesce("words", F.array().cast("array<string>")).alias("words"), F.coalesce("entrance", F.lit(False)).alias("entrance")
    listed = lambda rows, name, *of: rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("n", words, *of))).alias(name))
    both = listed(blocks, "_b", entrance).join(listed(scenes, "_s"), list(by), "left").select(*by, F.col("_b.n").alias("n"), F.col("_b.entrance").alias("_entrance"), F.col("_b.words").alias("_own"), F.col("_s.n").alias("_turn"), F.coalesce("_s.words", none).alias("_theirs"))
    starts = F.arrow_udf(arrays.starts, "array<int>")
    begun = lambda c: starts(F.transform(c, F.size))
    told = both.select(*by, "n", "_entrance", "_turn", begun("_own").alias("_start"), begun("_theirs").alias("_modern"), landmarks(F.flatten("_own"), F.flatten("_theirs")).alias("_chain"))
    later = F.filter(F.arrays_zip("_turn", "_modern"), lambda s: s["_turn"] > 0)
    told = told.select(*by, "n", F.arrays_zip("n", "_start", "_entrance").alias("_blocks"), F.transform(later, lambda s: counterpart(s["_modern"], F.col("_chain"))).alias("_wanted"))

    def cut(cuts: Column, at: Column) -> Column:
        off = lambda b: F.abs(b["_start"] - at) + F.when(b["_entrance"], 0).otherwise(ENTRANCE)
        best = F.array_min(F.transform(F.filter("_blocks", lambda b: b["n"] > F.element_at(cuts, -1)), lambda b: F.struct(off(b).alias("off"), b["n"].alias("n"))))
        return F.when(best.isNull(), cuts).otherwise(F.concat(cuts, F.array(best["n"])))

    cuts = F.aggregate(F.coalesce("_wanted", F.array().cast("array<int>")), F.array(F.lit(0)), cut)
    # cuts are told once a text, before its blocks are dealt out: told with each block they took a text's blocks squared
    return told.select(*by, cuts.alias("_cuts"), "n").select(*by, "_cuts", F.explode("n").alias("n")).select(*by, "n", (F.size(F.filter("_cuts", lambda c: c <= F.col("n"))) - 1).alias("piece"))


def scene_key(act: Column, kind: Column, n: Column) -> Column:
    """``2.1``, or ``prologue`` or ``5.epilogue``: by what scenes correspond."""
    return F.when(kind == "scene", F.concat(F.coalesce(act.cast("string"), F.lit("null")), F.lit("."), n.cast("string"))).when(act.isNull(), kind).otherwise(F.concat(act.cast("string"), F.lit("."), kind))


def renumbered(scenes: DataFrame, mapping: DataFrame, by: str) -> DataFrame:
    """``scenes`` (``by``, ``turn``, ``act``, ``kind``, ``no``) with the numbers that ``mapping`` (``by``, ``key``, ``target``) gives.

    A key that no scene has, and a target that is no scene of the same act, are errors; a mapping is a reviewed, short list.
    """
    keyed = scenes.withColumn("key", scene_key(F.col("act"), F.col("kind"), F.col("no")))
    unused = mapping.join(keyed, [by, "key"], "left_anti").limit(1).collect()
    if unused:
        raise ValueError(f"{unused[0][by]}: no printed scene {unused[0]['key']} to renumber")
    parts = F.split("target", r"\.")
    wrong = mapping.join(keyed, [by, "key"]).where((F.col("kind") != "scene") | ~F.coalesce((F.size(parts) == 2) & (parts[0].try_cast("int") == F.col("act")) & parts[1].try_cast("int").isNotNull(), F.lit(False))).limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0][by]}: cannot renumber {wrong[0]['key']} as {wrong[0]['target']}")
    told = keyed.join(mapping.select(by, "key", "target"), [by, "key"], "left")
    return told.withColumn("no", F.coalesce(parts[1].cast("int"), "no")).select(*scenes.columns)


def covered(printed: DataFrame, scenes: DataFrame, by: str) -> DataFrame:
    """``printed`` with ``first`` and ``upto``: the scenes, from the one of its own key up to that of the next printed scene, that it covers.

    Both have ``by``, ``turn``, ``act``, ``kind``, ``no``. A prologue or epilogue without the same key has the only one of its
    kind. A printed scene without counterpart, or printed scenes out of order, stop the job when its rows are read.
    """
    key = scene_key(F.col("act"), F.col("kind"), F.col("no")).alias("key")
    named = scenes.select(by, key, F.col("turn").alias("same"))
    only = scenes.groupBy(by, "kind").agg(F.min("turn").alias("only"), F.count("*").alias("m")).where("m = 1 and kind <> 'scene'").drop("m")
    size = scenes.groupBy(by).agg(F.count("*").cast("int").alias("size"))
    met = printed.withColumn("key", key).join(named, [by, "key"], "left").join(only, [by, "kind"], "left").join(size, by, "left").withColumn("first", F.coalesce("same", "only"))
    w = Window.partitionBy(by).orderBy("turn")
    says = lambda what: F.raise_error(F.concat(F.col(by).cast("string"), F.lit(f": scene "), F.col("key"), F.lit(what)))  # noqa: E731, F541
    first = F.when(F.col("first").isNull(), says(" has no counterpart")).when(F.col("first") <= F.lag("first").over(w), says(" is out of order")).otherwise(F.col("first"))
    return met.withColumn("upto", F.coalesce(F.lead("first").over(w), F.col("size"))).withColumn("first", first.cast("int")).select(*printed.columns, "first", "upto")


def supplied(printed: DataFrame, blocks: DataFrame, scenes: DataFrame, by: str) -> DataFrame:
    """``by``, ``turn``, ``n`` of each block with the ``act``, ``kind``, ``no`` of its scene and whether that is ``added``.

    ``blocks`` have ``by``, ``turn`` (their printed scene) and ``n`` within it; ``scenes`` have ``words``. A printed scene that
    covers several scenes is split by ``split``, and all but its first piece are added.
    """
    reach = covered(printed, scenes, by)
    many = reach.where("upto - first > 1")
    held = many.select(by, "turn", "first", F.explode(F.sequence("first", F.col("upto") - 1)).alias("scene"))
    theirs = scenes.select(by, F.col("turn").alias("scene"), F.col("act").alias("_act"), F.col("kind").alias("_kind"), F.col("no").alias("_no"), "words")
    pieces = held.join(theirs, [by, "scene"]).withColumn("n", F.col("scene") - F.col("first"))
    cut = split(blocks.join(many.select(by, "turn"), [by, "turn"], "left_semi"), pieces.select(by, "turn", "n", "words"), [by, "turn"])
    told = blocks.select(by, "turn", "n").join(cut, [by, "turn", "n"], "left").join(reach.select(by, "turn", "act", "kind", "no"), [by, "turn"])
    told = told.withColumn("piece", F.coalesce("piece", F.lit(0))).join(pieces.select(by, "turn", F.col("n").alias("piece"), "_act", "_kind", "_no"), [by, "turn", "piece"], "left")
    added = F.col("piece") > 0
    return told.select(by, "turn", "n", "piece", *[F.when(added, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("act", "kind", "no")], added.alias("added"))


def acts(scenes: DataFrame, printed: DataFrame, by: str) -> DataFrame:
    """``scenes`` (``by``, ``turn``, ``act``) in reading order with ``group``, the turn of their act, ``heading`` and ``editorial``.

    Neighbours of one act number share a group. An act that is printed (``by``, ``act``, ``heading``, ``editorial``) keeps what it has; another is editorial if it has a number.
    """
    same = F.coalesce(F.col("act") == F.lag("act").over(Window.partitionBy(by).orderBy("turn")), F.lit(False))
    known = printed.where("act is not null").dropDuplicates([by, "act"]).select(by, "act", "heading", F.col("editorial").alias("_editorial"))
    return order.islands(scenes, [by], "turn", same, "group").join(known, [by, "act"], "left").withColumn("editorial", F.coalesce("_editorial", F.col("act").isNotNull())).drop("_editorial")


def labels(blocks: DataFrame, scenes: DataFrame, by: Sequence[str], n: int = 3) -> DataFrame:
    """``by``, ``n``, ``label``: the scene whose n-grams a block's neighbourhood shares most, those of few scenes weighing more; null where it shares none.

    The neighbourhood reaches ``BESIDE`` words beyond the block on each side; of scenes that share as much, the first.
    A text's blocks are scored by running sums, a scene at a time.
    """
    arrays.bounded(blocks.sparkSession)
    types = [rows.schema["n"].dataType.simpleString() for rows in (blocks, scenes)]

    def of(turns: pa.Scalar, words: pa.Scalar, names: pa.Scalar, theirs: pa.Scalar) -> list[dict]:
        found = [None] * len(turns)
        if theirs.is_valid:
            own, other = words.values.flatten(), theirs.values.flatten()
            sizes, lengths = [x.values.value_lengths().to_numpy(zero_copy_only=False) for x in (words, theirs)]
            code = arrays.codes(pa.concat_arrays([own, other]), n)
            mine, rest = code[: max(len(own) - n + 1, 0)], code[len(own) :]
            known, name = np.unique(names.values.to_numpy(zero_copy_only=False), return_inverse=True)
            inside = np.arange(len(rest)) + n <= np.repeat(np.cumsum(lengths), lengths)[: len(rest)]
            met = np.unique(np.repeat(name, lengths)[: len(rest)][inside] + len(known) * rest[inside])
            gram, of = met // len(known), met % len(known)
            weight = np.floor(_UNIT / np.bincount(gram)[gram] + 0.5).astype(np.int64) if len(gram) else gram
            start = np.cumsum(sizes) - sizes
            a, b = np.maximum(start - BESIDE, 0), np.minimum(start + sizes + BESIDE - n + 1, len(mine))
            best, which = np.zeros(len(sizes), np.int64), np.full(len(sizes), -1)
            for k in range(len(known)):
                each = np.zeros(int(code.max(initial=0)) + 1, np.int64)
                each[gram[of == k]] = weight[of == k]
                sums = np.append(0, np.cumsum(each[mine]))
                score = np.where(a < b, sums[np.maximum(b, 0)] - sums[np.minimum(a, len(mine))], 0)
                which, best = np.where(score > best, k, which), np.maximum(score, best)
            found = [int(known[k]) if k >= 0 else None for k in which]
        return [{"n": t, "label": f} for t, f in zip(turns.values.to_pylist(), found, strict=True)]

    wide = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}
    told = arrays.by_row(of, pa.list_(pa.struct([("n", wide[types[0]]), ("label", wide[types[1]])])), f"array<struct<n:{types[0]},label:{types[1]}>>")
    listed = lambda rows, n, words: rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("n", F.coalesce("words", F.array().cast("array<string>")).alias("words")))).alias(n)).select(*by, F.col(f"{n}.n").alias(n), F.col(f"{n}.words").alias(words))
    both = listed(blocks, "turns", "words").join(listed(scenes.where("n is not null"), "names", "theirs"), list(by), "left")
    return both.select(*by, F.inline(told("turns", "words", "names", "theirs")))


def smoothed(runs: Sequence[tuple[int, int, int]], least: int = RUN) -> list[tuple[int, int, int]]:
    """Runs ``(label, from, size)`` in order without short ones: the first short run joins the run before it, or the next if it is the first, and neighbours of one label become one, until none is left."""
    out: list[list[int]] = []
    ahead = None
    for label, begin, size in runs:
        if ahead is not None:
            begin, size, ahead = ahead[1], size + ahead[2], None
        if out and (out[-1][0] == label or size < least):
            out[-1][2] += size
        elif size < least:
            ahead = [label, begin, size]
        else:
            out.append([label, begin, size])
    if ahead is not None:
        out.append(ahead)
    return [tuple(r) for r in out]


def _moved(runs: list[tuple[int, int, int]], starts: list[int], entrances: list[bool]) -> list[tuple[int, int]]:
    """``(label, from)`` of runs that begin at an entrance nearby where there is one."""
    begins = [r[1] for r in runs]
    for r in range(1, len(runs)):
        own, upto = begins[r], begins[r + 1] if r + 1 < len(runs) else len(starts)
        for d in [0, *(s * k for k in range(1, NEAR_BLOCKS + 1) for s in (-1, 1))]:
            b = own + d
            if begins[r - 1] < b < upto and entrances[b] and abs(starts[b] - starts[own]) <= NEAR_WORDS:
                begins[r] = b
                break
    return [(run[0], b) for run, b in zip(runs, begins, strict=True)]


def reordered(blocks: DataFrame, scenes: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by``, ``n``, ``run``, ``label``: the blocks in runs of one label, short runs folded into others, and runs begun at entrances.

    Blocks without label join the run before them; a text without any label is one run without. The kernel sees a
    text's labels and sizes, not its words.
    """
    told = _begun(blocks, by).join(labels(blocks, scenes, by), [*by, "n"]).select(*by, "n", F.coalesce("label", F.lit(-1)).cast("int").alias("label"), "size", "start", F.coalesce("entrance", F.lit(False)).alias("entrance"))
    arrays.bounded(blocks.sparkSession)

    def of(*columns: pa.Scalar) -> list[dict]:
        turns, labels, sizes, starts, entrances = [c.as_py() for c in columns]
        runs: list[list[int]] = []
        for k, (label, size) in enumerate(zip(labels, sizes, strict=True)):
            if runs and label in (-1, runs[-1][0]):
                runs[-1][2] += size
            else:
                runs.append([label, k, size])
        begun = _moved(smoothed([tuple(r) for r in runs]), starts, entrances)
        which = np.searchsorted([b for _, b in begun], np.arange(len(turns)), side="right") - 1
        return [{"n": t, "run": int(k), "label": begun[k][0]} for t, k in zip(turns, which, strict=True)]

    names = ("n", "label", "size", "start", "entrance")
    found = arrays.by_row(of, pa.list_(pa.struct([(c, pa.int32()) for c in ("n", "run", "label")])), "array<struct<n:int,run:int,label:int>>")
    listed = told.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("blocks"))
    return listed.select(*by, F.inline(found(*[F.col(f"blocks.{c}") for c in names])))


def named(runs: DataFrame, scenes: DataFrame, by: str) -> DataFrame:
    """``by``, ``run``, ``scene``: a run's scene key, runs without label that of the first scene; later uses of one get b, c, ..."""
    keyed = scenes.select(by, F.col("turn").alias("label"), scene_key(F.col("act"), F.col("kind"), F.col("no")).alias("scene"))
    told = runs.select(by, "run", F.greatest("label", F.lit(0)).alias("label")).distinct().join(keyed, [by, "label"])
    return order.recurrence(told, [by], "run", "scene").select(by, "run", "scene")


def curated(blocks: DataFrame, starts: DataFrame, scenes: DataFrame, by: str) -> DataFrame:
    """``by``, ``n``, ``run``, ``label`` of blocks by a reviewed list of ``starts`` (``by``, ``turn``, ``n``, ``scene`` key).

    Starts must be of blocks and scenes that are there, begin with the first block and rise; else the list is an error.
    """
    keyed = scenes.select(by, F.col("turn").alias("label"), scene_key(F.col("act"), F.col("kind"), F.col("no")).alias("scene"))
    told = starts.join(keyed, [by, "scene"], "left").join(blocks.select(by, "n", F.lit(True).alias("there")), [by, "n"], "left")
    lost = told.where("label is null or there is null").limit(1).collect()
    if lost:
        raise ValueError(f"{lost[0][by]}: curated scene {lost[0]['scene']} at {lost[0]['n']} not found")
    before = F.lag("n").over(Window.partitionBy(by).orderBy("turn"))
    if told.withColumn("before", before).where("n <= before or (before is null and n <> 0)").limit(1).collect():
        raise ValueError("curated scenes must start at the first block, in order")
    marked = blocks.join(told.select(by, "n", "turn", "label"), [by, "n"], "left")
    w = Window.partitionBy(by).orderBy("n")
    return marked.select(by, "n", F.last("turn", ignorenulls=True).over(w).alias("run"), F.last("label", ignorenulls=True).over(w).alias("label")).where("run is not null")
