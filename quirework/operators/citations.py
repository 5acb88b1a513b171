"""Finding the line that a citation means, by its scene, line number, headword and quotation.

Lines have ``scene``, ``idx`` (place in the scene, without gaps), ``number`` and ``words`` (array of keys). Citations
have ``id``, ``scene``, ``line``, ``head`` (a key) and ``quote`` (array of keys). Null arrays read as empty; citations
with a null or one-letter head are unsupported, and rows without id or scene and idx meet nothing.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.kept import kept

#: Letters that a form may have beyond its headword; lines about the predicted one; lead that a lone line needs.
EXTRA, NEAR, CLOSE, LEAD = 3, 15, 3, 8
#: Lines that a task searches for quotations of all scenes, and citations of one scene that are one row.
LINES, CITES = 1 << 16, 1_000


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.expr("cast(array() as array<string>)"))


def is_form(word: Column, head: Column) -> Column:
    return word.startswith(head) & (F.length(word) - F.length(head) <= EXTRA)


def in_scenes(lines: DataFrame) -> DataFrame:
    """``scene``, ``idx``, ``number``, ``words``: a scene's lines in order, as arrays."""
    told = lines.where("scene is not null and idx is not null").select("scene", F.struct("idx", "number", _list("words").alias("words")).alias("l"))
    return told.groupBy("scene").agg(F.array_sort(F.collect_list("l")).alias("l")).select("scene", *[F.col(f"l.{c}").alias(c) for c in ("idx", "number", "words")])


def _prefixes(word: str | None) -> list[str]:
    """The headwords that a word may be a form of."""
    return [word[:n] for n in range(max(2, len(word) - EXTRA), len(word) + 1)] if word else []


def with_quotes(cites: DataFrame) -> DataFrame:
    """Citations with ``quoted``: the distinct keys of over two letters that are no form of the head, and ``needed``: how many of them tell a line by themselves."""
    quoted = F.array_distinct(F.filter(_list("quote"), lambda k: (F.length(k) > 2) & ~is_form(k, F.col("head"))))
    told = cites.where("id is not null and length(head) >= 2").select("id", "scene", "line", "head", quoted.alias("quoted"))
    return told.withColumn("needed", F.greatest(F.lit(3), F.ceil(F.size("quoted") * 0.6)).cast("int"))


def candidates(cites: DataFrame, scenes: DataFrame) -> DataFrame:
    """Citations (``with_quotes``) of scenes that are there, with ``found``: the forms of the head in their scene (``idx``, ``number``, ``at``), and ``overlap``, how many quoted keys the line and those beside it hold.

    A scene's lines and its citations are a row, as many as ``CITES`` at a time, so neither words nor forms are moved one by one.
    """
    arrays.bounded(cites.sparkSession)

    def of(lines: pa.Scalar, heads: pa.Scalar, quotes: pa.Scalar) -> list[list[dict]]:
        lines, heads, quotes = lines.as_py(), heads.as_py(), quotes.as_py()
        forms, prefixes = {h: [] for h in heads}, cache(_prefixes)
        for k, words in enumerate(lines):
            for at, w in enumerate(words):
                for h in prefixes(w):
                    if h in forms:
                        forms[h].append((k, at))
        context = cache(lambda k: {w for words in lines[max(k - 1, 0) : k + 2] for w in words})
        return [[{"k": k, "at": at, "overlap": sum(q in context(k) for q in quoted)} for k, at in forms[h]] for h, quoted in zip(heads, quotes, strict=True)]

    met = arrays.by_row(of, pa.list_(pa.list_(pa.struct([(c, pa.int32()) for c in ("k", "at", "overlap")]))), "array<array<struct<k:int,at:int,overlap:int>>>")
    turn = F.row_number().over(Window.partitionBy("scene").orderBy("id"))
    own = [c for c in cites.columns if c != "scene"]
    asked = cites.join(scenes.select("scene"), "scene", "left_semi").withColumn("_turn", F.floor((turn - 1) / CITES)).groupBy("scene", "_turn").agg(F.collect_list(F.struct(*own)).alias("c"))
    both = asked.join(scenes, "scene").withColumn("f", met("words", "c.head", "c.quoted")).drop("words")
    placed = F.transform("f", lambda ms: F.transform(ms, lambda m: F.struct(F.get("idx", m["k"]).alias("idx"), F.get("number", m["k"]).alias("number"), m["at"].alias("at"), m["overlap"].alias("overlap"))))
    return both.select("scene", F.explode(F.arrays_zip("c", placed.alias("found"))).alias("z")).select("scene", *[F.col(f"z.c.{c}").alias(c) for c in own], "z.found")


def _strong() -> Column:
    """Of ``found`` the places of long quotations that agree well enough, in order."""
    good = F.filter("found", lambda m: (F.size("quoted") >= 3) & (m["overlap"] >= F.col("needed")))
    return F.array_sort(F.transform(good, lambda m: F.struct(m["idx"].alias("idx"), m["at"].alias("at"), m["number"].alias("number"))))


def predicted(cites: DataFrame, pairs: DataFrame, most: int = 5) -> DataFrame:
    """``cites`` with ``predicted``: the line plus the upper median offset of the ``most`` pairs of its scene that are nearest.

    Of pairs equally far the smaller cited line comes first, then the smaller teacher; scenes without pairs
    keep the line. Pairs are met by their rank beside the line, ``most`` to each side, never all by all.
    """
    up, down = Window.partitionBy("scene").orderBy("cited", "teacher"), Window.partitionBy("scene").orderBy("cited", F.desc("teacher"))
    ranked = pairs.where("cited is not null").withColumn("above", F.row_number().over(up)).withColumn("below", F.row_number().over(down))
    both = ranked.select("scene", F.col("cited").alias("x"), F.lit(None).cast(cites.schema["id"].dataType).alias("id")).unionByName(cites.select("scene", F.col("line").alias("x"), "id"))
    seen = both.withColumn("r", F.sum(F.when(F.col("id").isNull(), 1).otherwise(0)).over(Window.partitionBy("scene").orderBy("x").rangeBetween(Window.unboundedPreceding, 0))).where("id is not null")
    side = lambda name, a, b: seen.select("id", "scene", "x", F.explode(F.sequence(F.col("r") + a, F.col("r") + b)).alias(name)).join(ranked.select("scene", name, "cited", "number", "teacher"), ["scene", name])
    near = side("below", 1 - most, 0).drop("below").unionByName(side("above", 1, most).drop("above"))
    listed = F.slice(F.array_sort(F.collect_list(F.struct(F.abs(F.col("cited") - F.col("x")).alias("d"), "cited", "teacher", (F.col("number") - F.col("cited")).alias("o")))), 1, most)
    offset = near.groupBy("id").agg(F.array_sort(F.transform(listed, lambda p: p["o"])).alias("_o")).select("id", F.element_at("_o", (F.floor(F.size("_o") / 2) + 1).cast("int")).alias("_o"))
    return cites.join(offset, "id", "left").withColumn("predicted", F.col("line") + F.coalesce("_o", F.lit(0))).drop("_o")


def chosen(candidates: DataFrame) -> DataFrame:
    """``id``, ``scene``, ``idx``, ``at``, ``reason`` of citations with candidates near the predicted line; ``reason`` is null where one is chosen.

    A quotation of three words or more must share two with the line, the most shared then the nearest wins, and two
    lines alike in both are ambiguous. Otherwise the only line counts, or one much nearer than the next.
    """
    near = candidates.withColumn("distance", F.abs(F.col("number") - F.col("predicted"))).where(F.col("distance") <= NEAR)
    long = F.col("quotes") >= 3
    # short quotations take the last form of the head in a line, long ones the first
    lined = near.withColumn("_last", F.max("at").over(Window.partitionBy("id", "idx"))).where(long | (F.col("at") == F.col("_last")))
    rank = F.when(long & (F.col("overlap") >= 2), -F.col("overlap")).when(long, F.lit(1)).otherwise(F.lit(0))
    w = Window.partitionBy("id").orderBy("rank", "distance", "idx", "at")
    ahead = lined.withColumn("rank", rank).withColumn("_n", F.row_number().over(w))
    for c in ("rank", "distance", "idx"):
        ahead = ahead.withColumn(f"_{c}", F.lead(c).over(w))
    best = ahead.where("_n = 1")
    alike = (F.col("_rank") == F.col("rank")) & (F.col("_distance") == F.col("distance")) & (F.col("_idx") != F.col("idx"))
    clear = F.col("_idx").isNull() | ((F.col("distance") <= CLOSE) & (F.col("_distance") - F.col("distance") >= LEAD))
    reason = F.when(long & (F.col("rank") > 0), "quotation disagrees").when(long & F.coalesce(alike, F.lit(False)), "ambiguous").when(~long & ~clear, "ambiguous")
    return best.select("id", "scene", "idx", "at", reason.alias("reason"))


def _searched(asked: pa.Table, scenes: pa.Table) -> list[tuple]:
    """``(q, scene, idx, at)`` of the first and the last line that hold a form of a citation's ``head`` and, with those beside them, ``needed`` of ``quoted``.

    A key's lines are a number of one bit a line, so a citation costs a few operations on all lines.
    """
    words, starts = scenes["words"].combine_chunks(), np.append(0, np.cumsum(scenes["words"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)))
    lines = words.flatten()
    size = len(lines)
    line = np.repeat(np.arange(size), lines.value_lengths().to_numpy(zero_copy_only=False))
    coded = lines.flatten().dictionary_encode()
    codes, names = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    turn = np.argsort(codes, kind="stable")
    begins = np.searchsorted(codes[turn], np.arange(len(names) + 1))

    def number(at: np.ndarray) -> int:
        bits = np.zeros(size, bool)
        bits[at] = True
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    code = {w: k for k, w in enumerate(names)}
    holds = cache(lambda w: number(line[turn[begins[code[w]] : begins[code[w] + 1]]]) if w in code else 0)
    ends = starts[np.flatnonzero(np.diff(starts))]
    first, last = number(ends), number(starts[1:][np.diff(starts) > 0] - 1)

    @cache
    def beside(w: str) -> int:
        own = holds(w)
        return own | (own & ~last) << 1 | (own & ~first) >> 1

    heads = {h: [] for h in asked["head"].to_pylist()}
    for w in names:
        for h in _prefixes(w):
            if h in heads:
                heads[h].append(w)

    @cache
    def forms(h: str) -> int:
        told = 0
        for w in heads[h]:
            told |= holds(w)
        return told

    out, of = [], np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    for q, head, quoted, needed in zip(*[asked[c].to_pylist() for c in ("q", "head", "quoted", "needed")], strict=True):
        most = [forms(head), *[0] * needed]
        for n, w in enumerate(quoted if most[0] else ()):
            held = beside(w)
            for k in range(min(n + 1, needed), 0, -1):
                most[k] |= most[k - 1] & held
        met = most[needed]
        for k in {met.bit_length() - 1, (met & -met).bit_length() - 1} if met else ():
            scene, n = int(of[k]), int(k - starts[of[k]])
            at = next(i for i, w in enumerate(lines[int(k)].as_py()) if head in _prefixes(w))
            out.append((q, scenes["scene"][scene].as_py(), scenes["idx"][scene][n].as_py(), at))
    return out


def recovered(cites: DataFrame, scenes: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """``id``, ``scene``, ``idx``, ``at`` of citations (``with_quotes``) whose quotation is on one line alone of all ``in_scenes``, or of those that ``within`` (``id``, ``scene``) names.

    All scenes are searched ``LINES`` lines a task for every quotation, one of those that are alike: what is moved is the
    scenes once and the quotations once a task, and no pairs of both.
    """
    long = cites.where("size(quoted) >= 3").select("id", "head", F.array_sort("quoted").alias("quoted"), "needed")
    lone = lambda rows, key: rows.groupBy(key).agg(F.min(F.struct("scene", "idx", "at")).alias("a"), F.max(F.struct("scene", "idx")).alias("b")).where("a.scene = b.scene and a.idx = b.idx").select(key, "a.*")
    if within is not None:
        found = candidates(long.join(within, "id"), scenes).select("id", "scene", F.explode(_strong()).alias("m"))
        return lone(found.select("id", "scene", "m.idx", "m.at"), "id")
    total = scenes.agg(F.sum(F.size("idx"))).first()[0] or 0
    tasks = max(1, -(-total // LINES), min(scenes.sparkSession.sparkContext.defaultParallelism, total // 4096))
    asked = long.groupBy("head", "quoted", "needed").agg(F.min("id").alias("q"))
    types = {"q": cites.schema["id"].dataType, "scene": scenes.schema["scene"].dataType, "idx": scenes.schema["idx"].dataType.elementType}
    schema = ", ".join(f"{c} {t.simpleString()}" for c, t in types.items()) + ", at int"

    def search(asked: pa.Table, scenes: pa.Table) -> pa.Table:
        kinds = [asked.schema.field("q").type, scenes.schema.field("scene").type, scenes.schema.field("idx").type.value_type, pa.int32()]
        found = _searched(asked, scenes) if len(asked) and len(scenes) else []
        return pa.table({c: pa.array([r[k] for r in found], kinds[k]) for k, c in enumerate(("q", "scene", "idx", "at"))})

    here = scenes.select(F.pmod(F.xxhash64("scene"), F.lit(tasks)).cast("int").alias("task"), "scene", "idx", "words")
    everywhere = asked.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    found = lone(everywhere.groupBy("task").cogroup(here.groupBy("task")).applyInArrow(search, schema), "q")
    return found.join(asked.select("q", "head", "quoted"), "q").join(long.select("id", "head", "quoted"), ["head", "quoted"]).select("id", "scene", "idx", "at")


def match(lines: DataFrame, cites: DataFrame, prior: DataFrame | None = None, acts: DataFrame | None = None) -> DataFrame:
    """``id``, ``scene``, ``idx``, ``at``, ``recovered``, ``reason`` of every citation with an id; ``reason`` tells why one has no line.

    ``prior`` holds pairs (as ``learned`` gives) of another list of citations of the same numbering. What fails by
    scene, line or quotation is sought by its quotation, in its scene and then in all. With ``acts``, the numbered scenes'
    ``scene`` and ``act``, citations also have ``act``: without a scene they mean the only one of their act, and those whose
    scene is not there are sought in their act before all others.
    """
    if acts is not None:
        only = acts.groupBy("act").agg(F.min("scene").alias("_only"), F.count("*").alias("_m")).where("_m = 1").drop("_m")
        cites = cites.join(only, "act", "left").withColumn("scene", F.coalesce("scene", "_only")).drop("_only")
    told = kept(in_scenes(lines))
    asked = with_quotes(cites)
    there = told.select("scene", F.lit(True).alias("_there"))
    # a row a citation, with its scene's candidates
    found = candidates(asked, told).withColumn("_m", _strong()).withColumn("_there", F.lit(True))
    home = F.when((F.size("_m") > 0) & (F.get("_m", F.lit(0))["idx"] == F.element_at(F.when(F.size("_m") > 0, F.col("_m")), -1)["idx"]), F.get("_m", F.lit(0)))
    astray = asked.join(there, "scene", "left_anti")
    # unsupported ones are told with the others, so that citations are read once
    bad = cites.where("id is not null and (head is null or length(head) < 2)").select("id", F.lit(True).alias("_bad"))
    every = kept(found.withColumn("home", home).drop("_m").unionByName(astray, allowMissingColumns=True).unionByName(bad, allowMissingColumns=True))
    asked = every.where("_bad is null").drop("_bad")
    pairs = asked.where("home is not null").select("scene", F.col("line").alias("cited"), "home.number", F.col("id").alias("teacher"))
    if prior is not None:
        pairs = pairs.unionByName(prior.select(*pairs.columns))
    guess = predicted(asked.where("_there").select("id", "scene", "line"), pairs).select("id", "predicted")
    inside = asked.select("id", "scene", F.size("quoted").alias("quotes"), "found").join(guess, "id").select("id", "scene", "quotes", "predicted", F.inline("found"))
    first = chosen(inside)
    state = asked.drop("found").join(first.withColumnsRenamed({"scene": "_scene", "reason": "_reason"}), "id", "left")
    reason = F.when(F.col("_there").isNull(), "no such scene").when(F.col("idx").isNull(), "headword not found near cited line").otherwise(F.col("_reason"))
    lost = F.col("_reason").isin("no such scene", "headword not found near cited line", "quotation disagrees")
    # those that their own scene does not tell are sought in all
    state = state.withColumn("_reason", reason).withColumn("home", F.when(lost, F.col("home"))).withColumn("quoted", F.when(lost & F.col("home").isNull(), F.col("quoted")))
    state = kept(state.drop("_there", "line"))
    seek = state.where("quoted is not null").select("id", "scene", "head", "quoted", "needed")
    home = state.where("home is not null").select("id", "scene", "home.idx", "home.at")
    far = recovered(seek, told)
    name = lambda df, p: df.select("id", *[F.col(c).alias(p + c) for c in ("scene", "idx", "at")])
    none = home.limit(0)
    if acts is not None:
        astray = state.where("_reason = 'no such scene'")
        own = astray.select("id").join(cites.select("id", "act"), "id").join(acts.select("act", "scene"), "act").select("id", "scene")
        none = recovered(astray.select("id", "head", "quoted", "needed"), told, own)
    out = state.join(name(home, "h_"), "id", "left").join(name(none, "a_"), "id", "left").join(name(far, "f_"), "id", "left")
    found = F.col("h_idx").isNotNull() | F.col("a_idx").isNotNull() | F.col("f_idx").isNotNull()
    place = lambda c, own: F.coalesce("h_" + c, "a_" + c, "f_" + c, F.when(F.col("_reason").isNull(), F.col(own))).alias(c)
    answered = out.select("id", place("scene", "_scene"), place("idx", "idx"), place("at", "at"), found.alias("recovered"), F.when(~found, F.col("_reason")).alias("reason"))
    bad = every.where("_bad").select("id", F.lit("unsupported headword").alias("reason"))
    return answered.unionByName(bad.withColumn("recovered", F.lit(False)), allowMissingColumns=True)
