"""Sequence kernels for grouped work: alignment, word differences, chains and greedy buckets.

The kernels are small helpers that run inside grouped tasks; groups are blocks (a scene pair, a document pair).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays


#: Bits of masks that stay with a call of ``common``; masks beyond them are made again where they are needed.
_HELD = 1 << 30


def common(a: list[str], b: list[str], kept: int = 1024) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence; where both ways are as long, an item of ``a`` is skipped first.

    A row is a number of one bit an item of ``b``, the last item lowest, unset where lengths from an item of ``a`` on
    grow by one; rows are found from the ends, an addition each. Every ``kept``-th row stays, and on the way forward
    the rows up to the next one are found again. So memory is a bit a cell for ``len(a) / kept + kept`` rows, and
    ``_HELD`` bits of masks, at any size.
    """
    # items with which both begin are pairs in any case
    same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if same:
        return [(k, k) for k in range(same)] + [(i + same, j + same) for i, j in common(a[same:], b[same:], kept)]
    if not a or not b:
        return []
    size, places = len(b), {w: [] for w in a}
    for j, w in enumerate(b):
        if w in places:
            places[w].append(size - 1 - j)
    masks: dict[str, int] = {}

    def mask(w: str) -> int:
        """Where ``b`` has a word."""
        if w not in masks:
            bits = bytearray(size // 8 + 1)
            for k in places[w]:
                bits[k >> 3] |= 1 << (k & 7)
            made = int.from_bytes(bits, "little")
            if len(masks) * size > _HELD:
                return made
            masks[w] = made
        return masks[w]

    full = (1 << size) - 1

    def row(i: int, below: int) -> int:
        if not places[a[i]]:
            return below
        met = below & mask(a[i])
        return ((below + met) | (below - met)) & full

    marks, below = {}, full
    for i in range(len(a) - 1, -1, -1):
        if (i + 1) % kept == 0 or i == len(a) - 1:
            marks[i // kept] = below
        below = row(i, below)
    pairs, left = [], size
    for block in range(-(-len(a) // kept)):
        first, below, rows = block * kept, marks[block], {}
        for i in range(min(first + kept, len(a)) - 1, first - 1, -1):
            now = row(i, below)
            rows[i], below = now ^ below, now
        for i in range(first, min(first + kept, len(a))):
            # passing over the item costs nothing where an even number of growths differ behind the place
            if not left or not places[a[i]]:
                continue
            rest = (1 << left) - 1
            held = (mask(a[i]) & rest).bit_length()
            if held == left:
                pairs.append((i, size - left))
                left -= 1
            elif (differ := rows[i] & rest) and differ.bit_count() & 1:
                free = differ.bit_length() - 1
                if held > free:
                    pairs.append((i, size - held))
                    left = held - 1
                else:
                    left = free
    return pairs


def edits(a: str, b: str) -> int:
    """The least number of insertions, deletions and substitutions between two words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def equivalent(a: list[str], b: list[str]) -> bool:
    """As many words, each pair within a third of the longer word's letters, rounded up."""
    return len(a) == len(b) and all(x == y or edits(x, y) <= -(-max(len(x), len(y)) // 3) for x, y in zip(a, b, strict=True))


def difference(left: list[str], right: list[str]) -> list[tuple[str, str]]:
    """``(same|left|right, word)`` in order; between common words the right side's words come first where both lead as far."""
    pairs = [(j, i) for i, j in common(right, left)]
    out, i, j = [], 0, 0
    for x, y in [*pairs, (len(left), len(right))]:
        out += [("right", w) for w in right[j:y]] + [("left", w) for w in left[i:x]]
        if x < len(left) and y < len(right):
            out.append(("same", left[x]))
        i, j = x + 1, y + 1
    return out


def rising(values: list[int], strict: bool = True) -> list[int]:
    """Indices of a longest rising (or, if not strict, never falling) chain of values."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = (bisect_left if strict else bisect_right)(tails, v)
        back[i] = at[k - 1] if k else -1
        tails[k : k + 1], at[k : k + 1] = [v], [i]
    chain, i = [], at[-1] if at else -1
    while i >= 0:
        chain.append(i)
        i = back[i]
    return chain[::-1]


def buckets(tops: list[float], width: float = 4) -> list[int]:
    """The bucket of each sorted value; a value joins while it is less than ``width`` beyond the bucket's first."""
    out, first, n = [], None, -1
    for t in tops:
        if first is None or t - first >= width:
            first, n = t, n + 1
        out.append(n)
    return out


def chains(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Of each group's pairs ordered by ``a``, those on a longest chain strictly rising in ``b``."""

    arrays.bounded(pairs.sparkSession)
    chain = arrays.by_row(lambda values: rising(values.as_py()), pa.list_(pa.int32()), "array<int>")
    listed = pairs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(a, b, *[c for c in pairs.columns if c not in (*by, a, b)]))).alias("_rows"))
    told = listed.select(*by, "_rows", chain(F.col(f"_rows.{b}")).alias("_on"))
    return told.select(*by, F.inline(F.transform("_on", lambda i: F.get("_rows", i)))).select(*pairs.columns)


def align_blocks(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Aligns the two sides of each block.

    ``nodes`` has ``by``, ``side`` (``orig`` or ``modern``), ``n`` (order), ``kind`` and ``keys``
    (array of word keys). Words align if kind and key agree; nodes joined by aligned words form an
    entry, whose relation is ``same`` if all its words are ``equivalent``, else ``variant``; nodes without
    aligned words stand alone. Returns ``by``, ``entry``, ``orig``, ``modern`` (arrays of n), ``relation``.
    """
    arrays.bounded(nodes.sparkSession)

    def of(*columns: pa.Scalar) -> list[dict]:
        values = [c.as_py() for c in columns]
        tokens, words = {}, {}
        for s, (ns, kinds, keys) in zip(("orig", "modern"), (values[:3], values[3:]), strict=True):
            tokens[s] = [(i, f"{k}:{w}") for i, k, ws in zip(ns, kinds, keys, strict=True) for w in ws]
            words[s] = dict(zip(ns, keys, strict=True))
        links = [(tokens["orig"][i][0], tokens["modern"][j][0]) for i, j in common([w for _, w in tokens["orig"]], [w for _, w in tokens["modern"]])]
        entries: list[tuple[list[int], list[int]]] = []
        for o, m in links:  # pairs rise on both sides, so a node's pairs are neighbours
            if entries and (entries[-1][0][-1] == o or entries[-1][1][-1] == m):
                for xs, x in zip(entries[-1], (o, m), strict=True):
                    if xs[-1] != x:
                        xs.append(x)
            else:
                entries.append(([o], [m]))
        spoken = lambda s, ns: [w for n in ns for w in words[s][n]]
        out = [(o, m, "same" if equivalent(spoken("orig", o), spoken("modern", m)) else "variant") for o, m in entries]
        used = ({n for o, _ in entries for n in o}, {n for _, m in entries for n in m})
        out += [([n], [], "orig-only") for n in words["orig"] if n not in used[0]] + [([], [n], "modern-only") for n in words["modern"] if n not in used[1]]
        # in the original's order; what is modern alone stands before the first aligned entry that goes on behind it
        met = sorted((m[0], o[0]) for o, m in entries)
        follows, first = [m for m, _ in met], [o for _, o in met]
        first.append(max([*words["orig"], *first], default=0) + 1)
        out.sort(key=lambda e: (e[0][0], 1, 0) if e[0] else (first[bisect_right(follows, e[1][0])], 0, e[1][0]))
        return [{"entry": k, "orig": o, "modern": m, "relation": r} for k, (o, m, r) in enumerate(out)]

    told = pa.list_(pa.struct([("entry", pa.int32()), ("orig", pa.list_(pa.int32())), ("modern", pa.list_(pa.int32())), ("relation", pa.string())]))
    aligned = arrays.by_row(of, told, "array<struct<entry:int,orig:array<int>,modern:array<int>,relation:string>>")
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("n", "kind", "keys")))).alias(s)
    blocks = nodes.groupBy(*by).agg(side("orig"), side("modern"))
    return blocks.select(*by, F.inline(aligned(*[F.col(f"{s}.{c}") for s in ("orig", "modern") for c in ("n", "kind", "keys")])))
