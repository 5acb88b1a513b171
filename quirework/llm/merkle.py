"""A Merkle manifest of a table: leaves by source and id, authentication paths, and the check of other leaves against them.

Leaves of a source ascend by id, null ids first, rows that repeat an id by their digest. While several
nodes remain, every ``FAN`` consecutive ones, the last run fewer, become the digest of their hex texts.
What remains is the source's subroot; the subroots by source, null first, give the root alike.

A source is cut into aligned blocks of ``FAN ** HEIGHT`` leaves, a group of rows each. Block roots, a few
thousandths of the leaves, give the upper levels by plain joins and groups of ``FAN``. Then each block is
traversed once more: one treehash stack a level runs ahead by a run of its level, so that the path of each
leaf is at hand when its turn comes, with at most ``2 * FAN`` digests a level besides the block's leaves,
and the block's shared upper path is appended. No source, however large, is in one task.

A null field is ``-``. An empty table gives an empty manifest. Columns other than the five fields are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored

FAN = 16
#: Levels inside a block.
HEIGHT = 3

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """The digest of fields, each its UTF-8 byte count, a colon and its value, or ``-``."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def lowered(text: Column) -> Column:
    """The text with A-Z alone in lower case."""
    return F.translate(text, _UPPER, _LOWER)


class Stack:
    """A treehash stack: takes the nodes of level 0 one by one and gives the runs of siblings of ``level``.

    It holds at most ``FAN`` nodes a level.
    """

    def __init__(self, level: int) -> None:
        self.level, self.open = level, [[] for _ in range(level + 1)]

    def push(self, node: str) -> list[str] | None:
        """Adds a node; the run of siblings that it completes at this stack's level, if it does."""
        for h in range(self.level + 1):
            self.open[h].append(node)
            if len(self.open[h]) < FAN:
                return None
            run, self.open[h] = self.open[h], []
            if h == self.level:
                return run
            node = digest(run)
        return None

    def close(self) -> list[str] | None:
        """The run left when no more nodes come: shorter runs below become nodes of it."""
        for h in range(self.level):
            if self.open[h]:
                self.open[h + 1].append(digest(self.open[h]))
                self.open[h] = []
        run, self.open[self.level] = self.open[self.level], []
        return run or None


def block_root(leaves: list[str], height: int) -> str:
    """The node that ``height`` levels above the leaves of a block."""
    if height == 0:
        return leaves[0]
    stack = Stack(height - 1)
    for node in leaves:
        run = stack.push(node)
    return digest(run or stack.close())


def paths(leaves: list[str], height: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Per leaf, level by level, its place in its run of siblings and the run.

    Each level has its run in use and a stack that is one run ahead: it gets one leaf a step, so the next
    run is complete in the very step in which the run in use ends.
    """
    ahead = [Stack(h) for h in range(height)]
    feeds = [iter(leaves) for _ in range(height)]

    def feed(h: int) -> list[str] | None:
        node = next(feeds[h], None)
        return ahead[h].push(node) if node is not None else None

    def first(h: int) -> list[str]:
        for _ in range(FAN ** (h + 1)):
            run = feed(h)
        return run or ahead[h].close()

    current, coming = [first(h) for h in range(height)], [None] * height
    for at in range(len(leaves)):
        for h in range(height):
            if at and at % FAN ** (h + 1) == 0:
                current[h], coming[h] = coming[h] or ahead[h].close(), None
            coming[h] = feed(h) or coming[h]
        yield [(at // FAN**h % FAN, current[h]) for h in range(height)]


def fold(node: str, path: list[tuple[int, list[str]]]) -> str:
    """The node that ``node`` in its place gives above a path."""
    for place, run in path:
        node = digest([*run[:place], node, *run[place + 1 :]])
    return node


def _others(path: list[tuple[int, list[str]]]) -> str:
    return "".join("".join(run[:place]) + "".join(run[place + 1 :]) for place, run in path)


def numbered(rows: DataFrame, tree: str, *order: Column) -> DataFrame:
    """``rows`` with their ``index`` in the order within their ``tree`` and ``n``, how many it has.

    Rows are dealt by ranges of tree and order and stored with their place in the range; what trees have in
    earlier ranges comes from one row a range and tree, so no tree has to fit in one task.
    """
    dealt = rows.repartitionByRange(F.col(tree), *order).sortWithinPartitions(F.col(tree), *order)
    placed = stored(dealt.withColumn("place", F.monotonically_increasing_id())).withColumn("part", F.shiftright("place", 33))
    parts = placed.groupBy(tree, "part").agg(F.min("place").alias("first"), F.count("*").alias("m"))
    earlier = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("m").over(earlier), F.lit(0)) - F.col("first")
    begins = parts.select(tree, "part", shift.alias("shift"), F.sum("m").over(Window.partitionBy(tree)).alias("n"))
    return placed.join(begins, [tree, "part"]).withColumn("index", F.col("place") + F.col("shift")).drop("place", "part", "shift")


def climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tops of trees, and each node's path: ``(tree, node)``, and ``(tree, index, places, runs)``.

    ``nodes`` has ``tree``, ``index``, ``n``, how many the tree has, and ``node``. A level is one grouping
    of ``FAN`` neighbours; trees of one node are done and wait for the others.
    """
    level, passed = nodes.select("tree", "index", "n", "node"), []
    while level.where("n > 1").limit(1).count():
        above = level.groupBy("tree", "n", F.floor(F.col("index") / FAN).alias("above")).agg(F.sort_array(F.collect_list(F.struct("index", "node"))).alias("run"))
        passed.append(stored(above.select("tree", "n", "above", F.transform("run", lambda x: x["node"]).alias("run"))))
        node = F.when(F.col("n") > 1, F.sha2(F.array_join("run", "").cast("binary"), 256)).otherwise(F.col("run")[0])
        level = passed[-1].select("tree", F.col("above").alias("index"), F.ceil(F.col("n") / FAN).alias("n"), node.alias("node"))
    told = level.select("tree", "index", F.array().cast("array<int>").alias("places"), F.array().cast("array<array<string>>").alias("runs"))
    for run in reversed(passed):
        below = run.withColumnRenamed("above", "index").join(told, ["tree", "index"]).select("*", F.posexplode("run").alias("i", "node"))
        grown = lambda c, x: F.when(F.col("n") > 1, F.concat(F.array(x), c)).otherwise(F.col(c))
        told = below.select("tree", (F.col("index") * FAN + F.col("i")).alias("index"), grown("places", "i").alias("places"), grown("runs", "run").alias("runs"))
    return level.select("tree", "node"), stored(told)


def manifest(docs: DataFrame, told: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, source, leaf, subroot, root, proof_sha256, folded_root, verified)`` of each row of ``docs``.

    ``told`` is a leaf to be checked in the place of the row's own, null for its own. The digest of its
    siblings is ``proof_sha256``, and ``folded_root`` what the leaf to be checked gives with them.
    """
    fields = [F.col(c) for c in FIELDS]
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col("source"), leaf(*fields).alias("leaf"), (F.lit(None).cast("string") if told is None else told).alias("told"))
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = numbered(own.withColumn("tree", tree), "tree", F.asc_nulls_first("id"), F.asc("leaf"))
    size = FAN**HEIGHT
    rows = stored(rows.withColumn("block", F.floor(F.col("index") / size)).withColumn("id", F.col("id").cast("string")))
    height = lambda n: next((h for h in range(HEIGHT) if n <= FAN**h), HEIGHT)

    def root_of(block: pd.DataFrame) -> pd.DataFrame:
        first, leaves = block.iloc[0], block.sort_values("index")["leaf"].tolist()
        return pd.DataFrame({"tree": [first["tree"]], "index": [first["block"]], "n": [-(-first["n"] // size)], "node": [block_root(leaves, height(first["n"]))]})

    nodes = stored(rows.select("tree", "block", "index", "n", "leaf").groupBy("tree", "block").applyInPandas(root_of, "tree string, index long, n long, node string"))
    subroots, inside = climb(nodes)
    # sources are the leaves of one more tree
    tops = stored(numbered(subroots.withColumn("forest", F.lit("")), "forest", F.asc("tree")))
    roots, over = climb(tops.select(F.col("forest").alias("tree"), "index", "n", "node"))
    root = [r["node"] for r in roots.collect()]  # one, or none of an empty table
    over = stored(tops.join(over.drop("tree"), "index").select("tree", F.col("node").alias("subroot"), F.col("places").alias("more"), F.col("runs").alias("others")))
    over = F.broadcast(over) if small(over, 100_000) else over
    upper = inside.join(over, "tree").select("tree", F.col("index").alias("block"), "subroot", F.concat("places", "more").alias("places"), F.concat("runs", "others").alias("runs"))

    def traverse(block: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("index")
        shared = [(int(p), list(r)) for p, r in zip(upper["places"].iloc[0], upper["runs"].iloc[0], strict=True)]
        tail, tops, proofs, folded = _others(shared), {}, [], []
        leaves = block["leaf"].tolist()
        for given, own, path in zip(block["told"], leaves, paths(leaves, height(block["n"].iloc[0])), strict=True):
            proofs.append(digest([_others(path), tail]))
            node = fold(given or own, path)
            # what the upper path makes of a block's root is worked out once
            if node not in tops:
                tops[node] = fold(node, shared)
            folded.append(tops[node])
        return pd.DataFrame({"id": block["id"], "source": block["source"], "leaf": leaves, "subroot": upper["subroot"].iloc[0], "proof_sha256": proofs, "folded_root": folded})

    proved = rows.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInPandas(traverse, "id string, source string, leaf string, subroot string, proof_sha256 string, folded_root string")
    whole = F.lit(root[0] if root else None).cast("string")
    return proved.select(F.col("id").cast(kind).alias(id_col), "source", "leaf", "subroot", whole.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == whole).alias("verified"))
