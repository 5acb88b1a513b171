"""SimHash near-duplicate groups, searched with pivot distance tables.

**Fingerprints.** A text's words (ASCII letters lower-cased) give shingles, repeats included; a
fingerprint bit is 1 where over half of the shingles' XXH64 have it set. Fingerprints link where
at most two bits differ, and linked fingerprints form groups.

**Search.** A table holds every distinct fingerprint's Hamming distance to many reference
fingerprints. The references of one block of bits differ from the zero reference in that block
alone, so a distance less the distance to zero depends on that block only. Two differing bits
leave at least two of the four blocks alike, and so all coordinates of two blocks equal: those
coordinates are the join key. A pair that meets is discarded if any coordinate of the table
differs by more than two (triangle inequality); survivors are verified bit by bit.

**Crowded keys.** Where more than ``crowd`` fingerprints share a key, pairs are not formed. Each
of those fingerprints is sent to itself and to its 64 neighbours at one bit; two fingerprints
differ in at most two bits exactly when they meet at one of these, and whoever meets is linked to
the smallest there. That is linear in the fingerprints and loses no link.

**Similar texts.** ``keep_one`` groups texts whose sets of five-word shingles have a Jaccard similarity
of 0.8 or more, and no distance between fingerprints is proven to hold all of those. So the links above,
over five-word fingerprints, and the texts that share a rare shingle with a hub only start the groups;
a prefix filter then finds every further pair. Of a set of ``n`` shingles in one order for all texts, the
first ``n - ceil(0.8 n) + 1`` hold a shingle of every set as similar, so similar texts meet at one.
Texts of one group need not meet again. Pivots discard most pairs that meet: the universe of shingles is
dealt to ``_PIVOTS`` reference sets, a table holds how many shingles of each text lie in each, and the sums
of the coordinate differences of two texts never exceed the shingles they do not share. Survivors are
verified on their whole texts. Shingles common in a sample come last in the order, the most common at the
end; that bounds how many meet, not what is found.

Nulls and empty texts have fingerprint zero. Rows with a null id take part; a group's smallest id
ignores nulls and is null only where all are. Repeated rows get the same answer. Empty tables give
empty results.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, fresh, small, stored

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BITS = 64
_BLOCKS = 4
_STEP = 1 << 14
#: The Jaccard similarity of shingle sets from which texts are near copies, as a fraction.
_SIMILAR = (4, 5)
#: Into how many reference sets shingles are dealt.
_PIVOTS = 64


def shingle_hashes(text: str | None, shingle: int = 3, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of one text, repeats included, in slices."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return
    joined = b" ".join(tokens)
    length = np.fromiter(map(len, tokens), np.int64, len(tokens))
    end = np.cumsum(length + 1) - 1
    start = end - length
    k = min(shingle, len(tokens))
    n = len(tokens) - k + 1
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, _STEP):
        hi = min(n, lo + _STEP)
        spans = zip(start[lo:hi].tolist(), end[lo + k - 1 : hi + k - 1].tolist(), strict=True)
        yield np.fromiter((digest(joined[a:b], seed) for a, b in spans), "<u8", hi - lo)


def majority(slices: Iterable[np.ndarray]) -> int:
    """The unsigned SimHash of shingle hashes; bit counts are summed over the slices."""
    counts, n = np.zeros(_BITS, np.int64), 0
    for h in slices:
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned SimHash of one text."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprint_column(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """Fingerprints as signed 64-bit numbers, a batch of texts at a time."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.array([fingerprint(t if isinstance(t, str) else None, shingle, seed) for t in s], np.uint64).view(np.int64))

    return of(text)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def references(per_block: int = 12) -> list[list[int]]:
    """``per_block`` reference fingerprints for each block, zero outside it; the same on each run."""
    draw, width = random.Random(64), _BITS // _BLOCKS
    return [[draw.getrandbits(width) << (b * width) for _ in range(per_block)] for b in range(_BLOCKS)]


def pivot_table(fps: DataFrame, per_block: int = 12) -> DataFrame:
    """``fp`` with ``zero`` (distance to the zero reference) and ``d0..d3``: arrays of distances to each block's references."""
    distance = lambda r: F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(r)))).cast("byte")
    cols = [F.array(*[distance(r) for r in block]).alias(f"d{b}") for b, block in enumerate(references(per_block))]
    return fps.select("fp", distance(0).alias("zero"), *cols)


def links(fps: DataFrame, crowd: int = 32) -> DataFrame:
    """Links ``(a, b)``, ``a < b``, whose components are those of all pairs at two bits or fewer. ``fps`` has distinct ``fp``."""
    relative = lambda b: F.concat_ws(",", F.transform(F.col(f"d{b}"), lambda d: (d - F.col("zero")).cast("int").cast("string")))
    pairs = [(i, j) for i in range(_BLOCKS) for j in range(i + 1, _BLOCKS)]
    keyed = (
        pivot_table(fps)
        .select("fp", F.concat("d0", "d1", "d2", "d3").alias("table"), *[relative(b).alias(f"r{b}") for b in range(_BLOCKS)])
        .select("fp", "table", F.inline(F.array(*[F.struct(F.xxhash64(F.lit(n), f"r{i}", f"r{j}").alias("key")) for n, (i, j) in enumerate(pairs)])))
    )
    keyed = cut(keyed)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    few = keyed.join(sizes.where(F.col("n") <= crowd).select("key"), "key")
    near = F.forall(F.zip_with("table", "other", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), lambda d: d <= 2)
    met = (
        few.select("key", F.col("fp").alias("a"), "table")
        .join(few.select("key", F.col("fp").alias("b"), F.col("table").alias("other")), "key")
        .where(F.col("a") < F.col("b"))
        .where(near)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
        .select("a", "b")
    )
    crowded = keyed.join(sizes.where(F.col("n") > crowd).select("key"), "key", "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0), *[F.lit(_signed(1 << i)) for i in range(_BITS)])
    around = crowded.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("at"))
    smallest = around.groupBy("at").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("at", "a")
    star = around.join(smallest, "at").where("fp > a").select("a", F.col("fp").alias("b"))
    return met.unionByName(star).distinct()


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """``(node, root)`` for each node of ``edges`` (``a``, ``b``): the smallest node reachable.

    Each round every node takes the smallest root among its neighbours' and its own, hooks its old
    root to it, and then jumps to its root's root. Each round is checkpointed.
    """
    edges = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
    labels = cut(labels)
    for _ in range(rounds):
        seen = edges.join(labels.select(F.col("node").alias("a"), "root"), "a").groupBy(F.col("b").alias("node")).agg(F.min("root").alias("m"))
        best = labels.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("new"))
        hooks = best.select(F.col("old").alias("node"), "new").unionByName(best.select("node", "new")).groupBy("node").agg(F.min("new").alias("new"))
        hooks = cut(hooks)
        jump = hooks.select(F.col("node").alias("new"), F.col("new").alias("next"))
        after = cut(hooks.join(jump, "new", "left").select("node", F.coalesce("next", "new").alias("root")))
        changed = after.join(labels.withColumnRenamed("root", "before"), "node").where("root <> before").limit(1).count()
        labels = after
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, crowd: int = 32) -> DataFrame:
    """``(id_col, fp, component_id, root)`` for each row of ``docs``; ``root`` is the group's smallest fingerprint."""
    rows = cut(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), shingle).alias("fp")))
    fps = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(fps.select("fp"), crowd))
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    group = named.join(first, "root").select("fp", "component_id", "root")
    return rows.join(group, "fp").select(F.col("id").alias(id_col), "fp", "component_id", "root")


def signature(text: str | None, shingle: int, common: tuple[np.ndarray, np.ndarray]) -> tuple[int, int, int, np.ndarray, int, bytes]:
    """A text's SimHash, the hash of its shingle set, the set's size, the first shingles that any similar set shares one of, how many of those are not common, and its row of the pivot table."""
    slices = list(shingle_hashes(text, shingle))
    found = np.unique(np.concatenate(slices)) if slices else np.zeros(0, "<u8")
    known, times = common
    at = np.minimum(np.searchsorted(known, found), max(len(known) - 1, 0))
    late = known[at] == found if len(known) else np.zeros(len(found), bool)
    n = len(found)
    last = found[late][np.argsort(times[at[late]], kind="stable")] if len(known) else found[late]
    head = np.concatenate([found[~late], last])[: n - (_SIMILAR[0] * n + _SIMILAR[1] - 1) // _SIMILAR[1] + 1]
    pivots = np.minimum(np.bincount((found % _PIVOTS).astype(np.int64), minlength=_PIVOTS), 255).astype(np.uint8)
    return _signed(majority(slices)), _signed(xxhash.xxh64_intdigest(found.tobytes())), n, head.view(np.int64), min(len(head), n - int(late.sum())), pivots.tobytes()


def node_column(text: Column, shingle: int = 5) -> Column:
    """The hash of each text's shingle set."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        none = np.zeros(0, "<u8"), np.zeros(0, np.int64)
        for s in batches:
            yield pd.Series([signature(t if isinstance(t, str) else None, shingle, none)[1] for t in s], dtype="int64")

    return of(text)


def common_shingles(docs: DataFrame, text_col: str, shingle: int, sample: int = 40_000, least: int = 3, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``most`` shingles that most of about ``sample`` texts have, ``least`` at the least, and how many have them; they only order the search."""
    n = docs.count()

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for t in rows[text_col]:
                for h in shingle_hashes(t if isinstance(t, str) else None, shingle):
                    yield pd.DataFrame({"shingle": np.unique(h).view(np.int64)})

    drawn = docs.where(F.pmod(F.xxhash64(F.lit(5), text_col), F.lit(1_000_000)) < int(1_000_000 * min(1, sample / max(n, 1)))).select(text_col).distinct()
    bound_batches(docs.sparkSession)
    often = drawn.mapInPandas(of, "shingle long").groupBy("shingle").count().where(F.col("count") >= least)
    often = often.orderBy(F.col("count").desc(), "shingle").limit(most).toPandas()
    known, times = often["shingle"].to_numpy(np.int64).view(np.uint64), often["count"].to_numpy(np.int64)
    return known[np.argsort(known)], times[np.argsort(known)]


def survivors(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of nodes that sizes and pivots cannot tell apart."""

    @F.pandas_udf("boolean")
    def near(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for s, t, most in batches:
            rows = [np.frombuffer(b"".join(x), np.uint8).reshape(-1, _PIVOTS).astype(np.int16) for x in (s, t)]
            yield pd.Series(np.abs(rows[0] - rows[1]).sum(axis=1) * (_SIMILAR[0] + _SIMILAR[1]) <= most.to_numpy())

    of = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("pivots").alias(f"p_{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    up, down = _SIMILAR
    sizes = F.least("n_a", "n_b") * down >= F.greatest("n_a", "n_b") * up
    return both.where(sizes).where(near("p_a", "p_b", (F.col("n_a") + F.col("n_b")) * (down - up))).select("a", "b")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, most: int = 500_000) -> DataFrame:
    """The pairs ``(a, b)`` of distinct shingle sets that are similar, by their whole texts.

    ``nodes`` says in which row (``id``, ``text_hash``) a set's text is found. Where at most ``most`` texts
    are wanted, their keys are broadcast to the documents; beyond that the join shuffles.
    """

    @F.pandas_udf("boolean")
    def similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def of(text: str) -> np.ndarray:
            slices = list(shingle_hashes(text, shingle))
            return np.unique(np.concatenate(slices)) if slices else np.zeros(0, "<u8")

        last: tuple[str | None, np.ndarray] = (None, np.zeros(0, "<u8"))
        for s, t in batches:
            out = np.zeros(len(s), bool)
            for i, (x, y) in enumerate(zip(s, t, strict=True)):
                if x != last[0]:
                    last = (x, of(x))
                other = of(y)
                shared = len(np.intersect1d(last[1], other, assume_unique=True))
                out[i] = shared * (_SIMILAR[0] + _SIMILAR[1]) >= (len(last[1]) + len(other)) * _SIMILAR[0]
            yield pd.Series(out)

    def texts(wanted: DataFrame, text: str) -> DataFrame:
        wanted = F.broadcast(wanted) if small(wanted, most) else wanted
        rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.coalesce(F.col(text_col), F.lit("")).alias(text))
        return rows.join(wanted, (rows["text_hash"] == wanted["text_hash"]) & rows["id"].eqNullSafe(wanted["id"])).drop("id", "text_hash")

    met = cut(survivors(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), nodes))
    of = lambda x: nodes.select(F.col("node").alias(x), "id", "text_hash")
    members = texts(cut(met.join(of("b"), "b")), "t")
    heads = texts(cut(met.select("a").distinct().join(of("a"), "a")), "s")
    return cut(members.join(heads, "a").where(similar("s", "t")).select("a", "b").distinct())


def _joined(roots: DataFrame, found: DataFrame) -> DataFrame:
    """``roots`` (``node``, ``n``, ``root``) after the pairs ``found`` of nodes have joined their groups."""
    of = lambda x, y: roots.select(F.col("node").alias(x), F.col("root").alias(y))
    bridges = found.join(of("a", "x"), "a").join(of("b", "y"), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    tops = components(bridges).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return stored(roots.join(tops, "root", "left").select("node", "n", F.coalesce("top", "root").alias("root")))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``(id_col, node, component_id, root)`` for each row of ``docs``: ``node`` names its shingle set, ``root`` the group of sets that similar pairs join.

    Two sets that meet at places ``p``, ``q`` of their orders share at most ``min(n - p, m - q)`` shingles.
    So they are apart unless ``5 n - 9 p >= 4 m`` and ``5 m - 9 q >= 4 n``; the left sides are kept as ``reach``.
    """
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text_col, shingle))
    up, down = _SIMILAR

    @F.pandas_udf("fp long, node long, n long, head array<long>, own int, pivots binary")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([signature(t if isinstance(t, str) else None, shingle, common.value) for t in s], columns=["fp", "node", "n", "head", "own", "pivots"])

    signed = stored(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), sign(F.col(text_col)).alias("s")).select("id", "text_hash", "s.*"))
    rows = signed.select("id", "node")
    nodes = stored(signed.groupBy("node").agg(F.first(F.struct("id", "text_hash", "fp", "n", "pivots")).alias("one")).select("node", "one.*"))
    heads = signed.select("node", "own", F.posexplode("head").alias("at", "token"))
    # most shingles are one text's own and go here. Those that no sample knows as common are in few texts and meet
    # in one shuffle; common ones may be in any number of texts, so they are counted first
    of_token = Window.partitionBy("token")
    few = heads.where("at < own").select("token", "node", "at").withColumns({"lo": F.min("node").over(of_token), "hi": F.max("node").over(of_token)}).where("lo <> hi").select("token", "node", "at")
    many = heads.where("at >= own").select("token", "node", "at")
    often = many.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("token")
    met = few.unionByName(many.join(often, "token", "left_semi")).groupBy("token", "node").agg(F.min("at").alias("at"))
    met = met.join(nodes.select("node", "n"), "node")
    met = stored(met.select("token", "node", "n", (F.col("n") * down - F.col("at") * (up + down)).alias("reach")))
    # of the texts that meet, the one that the fewest own shingles set apart is the hub, as it is similar to most
    hub = F.min(F.struct((F.col("n") * down - F.col("reach")).alias("own"), "n", "node", "reach")).alias("h")
    hubs = met.join(met.groupBy("token").agg(hub), "token").where("node <> h.node").select("node", "n", "reach", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.reach").alias("hub_reach"))
    hubs = stored(hubs.where((F.col("reach") >= F.col("hub_n") * up) & (F.col("hub_reach") >= F.col("n") * up)).groupBy("node", "hub").agg(F.count("*").alias("times")))

    least = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    near = links(least.select("fp")).join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    alike = nodes.select("fp", "node").join(least, "fp").select(F.col("least").alias("a"), F.col("node").alias("b"))
    mine = hubs.groupBy("node").agg(F.max(F.struct("times", "hub")).alias("m")).select(F.col("m.hub").alias("a"), F.col("node").alias("b"))
    roots = nodes.select("node", "n", F.col("node").alias("root"))
    roots = _joined(roots, verified(near.unionByName(alike).unionByName(mine), nodes, docs, id_col, text_col, shingle))
    of = lambda x, y: roots.select(F.col("node").alias(x), F.col("root").alias(y))
    rest = hubs.select(F.col("hub").alias("a"), F.col("node").alias("b")).join(of("a", "x"), "a").join(of("b", "y"), "b").where("x <> y")
    roots = _joined(roots, verified(rest.select("a", "b"), nodes, docs, id_col, text_col, shingle))

    # what is left: texts of different groups that meet, and of these only such as some text of another group can be similar to
    apart = stored(met.join(roots.select("node", "root"), "node"))
    sides = apart.groupBy("token", "root").agg(F.max("reach").alias("reach"), F.min("n").alias("n"))
    best = sides.groupBy("token").agg(F.max(F.struct("reach", "root")).alias("far"), F.min(F.struct("n", "root")).alias("low"), F.count("*").alias("groups")).where("groups > 1")
    second = sides.join(best, "token").groupBy("token").agg(F.first("far").alias("far"), F.first("low").alias("low"), F.max(F.when(F.col("root") != F.col("far.root"), F.col("reach"))).alias("far_2"), F.min(F.when(F.col("root") != F.col("low.root"), F.col("n"))).alias("low_2"))
    other_far = F.when(F.col("root") == F.col("far.root"), F.col("far_2")).otherwise(F.col("far.reach"))
    other_low = F.when(F.col("root") == F.col("low.root"), F.col("low_2")).otherwise(F.col("low.n"))
    able = apart.join(second, "token").where((other_far >= F.col("n") * up) & (F.col("reach") >= other_low * up)).select("token", "node", "n", "reach", "root")
    # sets as similar differ by one size class at most, so the smaller meets the larger in its own class
    own = F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / float(np.log(down / up))).cast("int")
    open_ = stored(able.withColumn("own", own).withColumn("size", F.explode(F.array(F.col("own"), F.col("own") - 1))))
    mine_ = F.col("own") == F.col("size")
    per = open_.groupBy("token", "size", "root").agg(F.max("reach").alias("reach"), F.min("n").alias("n"), F.max(F.when(mine_, F.col("reach"))).alias("own_reach"), F.min(F.when(mine_, F.col("n"))).alias("own_n"))
    groups = per.groupBy("token", "size").agg(F.collect_list(F.struct("root", "reach", "n")).alias("all"), F.collect_list(F.when(F.col("own_n").isNotNull(), F.struct("root", "own_reach", "own_n"))).alias("small"))
    # only the groups that some two members could link are paired
    both = groups.select("token", "size", F.explode("small").alias("s"), "all")
    able_ = F.filter("all", lambda x: (x["root"] != F.col("s.root")) & (F.col("s.own_reach") >= x["n"] * up) & (x["reach"] >= F.col("s.own_n") * up))
    both = both.select("token", "size", F.col("s.root").alias("root_a"), F.explode(F.transform(able_, lambda x: x["root"])).alias("root_b"))
    side = lambda x: [F.col("root").alias(f"root_{x}"), F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("reach").alias(f"reach_{x}")]
    pairs = both.join(open_.where("own = size").select("token", "size", *side("a")), ["token", "size", "root_a"]).join(open_.select("token", "size", *side("b")), ["token", "size", "root_b"])
    fits = (F.col("n_a") <= F.col("n_b")) & (F.col("reach_a") >= F.col("n_b") * up) & (F.col("reach_b") >= F.col("n_a") * up)
    roots = _joined(roots, verified(pairs.where(fits).select("a", "b"), nodes, docs, id_col, text_col, shingle))
    told = rows.join(roots.select("node", "root"), "node")
    ids = told.groupBy("root").agg(F.min("id").alias("component_id"))
    return told.join(ids, "root").select(F.col("id").alias(id_col), "node", "component_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the row of smallest id of each group of similar texts, its columns as they are.

    Rows whose id is null or repeated are told apart by their text: one of those that hold a
    group's smallest id stays, and a group without any id keeps one row.
    """
    groups = stored(similar_groups(docs, id_col, text_col).select(F.col(id_col).alias("id"), "node", F.col("component_id").alias("of"), "root"))
    ids = groups.groupBy("id").agg(F.count("*").alias("n"), F.min("of").alias("of"))
    mark, odd_id, node, root = (fresh(docs.columns, c) for c in ("_mark", "_odd", "_node", "_root"))
    lone = ids.where("n = 1 and id = of").select(F.col("id").alias(mark))
    kept = docs.join(lone, F.col(id_col) == F.col(mark), "left_semi")
    odd = cut(ids.where("n > 1 or id is null").select(F.col("id").alias(odd_id)))
    if odd.limit(1).count() == 0:
        return kept
    heads = groups.join(odd, F.col("id").eqNullSafe(F.col(odd_id)), "left_semi").where(F.col("id").eqNullSafe(F.col("of"))).select(F.col("id").alias(mark), F.col("node").alias(node), F.col("root").alias(root)).distinct()
    marked = docs.join(odd, F.col(id_col).eqNullSafe(F.col(odd_id)), "left_semi").withColumn(odd_id, node_column(F.col(text_col)))
    again = marked.join(heads, F.col(id_col).eqNullSafe(F.col(mark)) & (F.col(odd_id) == F.col(node))).dropDuplicates([root])
    return kept.unionByName(again.select(*docs.columns))
