"""Stored anchors held against the text as it is now, and found again where the text has moved.

An anchor that still spans its quotation is valid. Else its quotation is searched in the whole text of its
key, nodes joined by line ends, and the place whose surroundings agree best is taken if no other agrees as
well; without such a place the anchor is unattached. Anchors and nodes are those of ``anchors``, and anchors
also have ``exact``, ``prefix`` and ``suffix``; a null one is empty. An empty quotation, or one of line ends
alone, is nowhere. Surroundings are those in the outer nodes, as quotations are made; a line end in them
agrees with nothing. Empty tables give empty results, and other columns of the tables are not read.

Texts with lost anchors are rows, their lines joined and their quotations beside them, and go to a small helper
that reads each text once: a few quotations are sought one by one, many by an index of the text's grams of ``q``
characters, ``q`` at most the quotation, that is looked up with the rarest gram of each. So a text costs about its
length and the places of its quotations, however many anchors it has; of the places those that agree best so far
are held on to, character by character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.kept import kept
from . import anchors, notes

#: Lengths of grams.
GRAMS = (8, 4, 2, 1)
#: Quotations of a text that are sought one by one.
FEW = 64


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A number for each run of ``q`` characters, the same where runs are."""
    found, n = codes.astype(np.uint64), 1
    while n < q:
        found = found[:-n] * np.uint64(0x9E3779B97F4A7C15 + 2 * n) + found[n:] * np.uint64(0xC2B2AE3D27D4EB4F)
        found ^= found >> np.uint64(29)
        n *= 2
    return found


def places(text: str, quotes: list[str], few: int = FEW) -> dict[str, np.ndarray]:
    """Where each of the quotations, none of them empty, occurs in the text, overlaps too."""
    told = {}
    if len(quotes) <= few:
        for quote in quotes:
            at, found = text.find(quote), []
            while at >= 0:
                found.append(at)
                at = text.find(quote, at + 1)
            told[quote] = np.array(found, np.int64)
        return told
    codes = _codes(text)
    for q in GRAMS:
        mine = [x for x in quotes if len(x) >= q and x not in told and len(x) <= len(text)]
        if not mine:
            continue
        grams = _grams(codes, q)
        order = np.argsort(grams, kind="stable")
        grams = grams[order]
        for quote in mine:
            own = _grams(_codes(quote), q)
            begins, ends = np.searchsorted(grams, own), np.searchsorted(grams, own, "right")
            k = int(np.argmin(ends - begins))
            found = order[begins[k] : ends[k]] - k
            told[quote] = np.array([p for p in found.tolist() if p >= 0 and text.startswith(quote, p)], np.int64)
    return told | {x: np.array([], np.int64) for x in quotes if x not in told}


def _agree(codes: np.ndarray, at: np.ndarray, step: int, wanted: np.ndarray) -> np.ndarray:
    """How many characters from each place on, forward or backward, are those wanted."""
    count, left = np.zeros(len(at), np.int64), np.arange(len(at))
    for k, c in enumerate(wanted):
        on = at[left] + step * k
        left, on = (x[(on >= 0) & (on < len(codes))] for x in (left, on))
        left = left[codes[on] == c]
        if not len(left):
            break
        count[left] += 1
    return count


def _best(text: str, idx: np.ndarray, quotes: list[tuple[str, str, str]]) -> list[tuple[int, int, int, int] | None]:
    """The span that each quotation with its prefix and suffix has in a text of lines numbered ``idx``; none where no place agrees best."""
    met = places(text, list({x for x, _, _ in quotes}))
    codes = _codes(text).copy()
    begins = np.append(0, np.flatnonzero(codes == 10) + 1)
    codes[begins[1:] - 1] = -1  # agrees with nothing
    node = lambda at: np.searchsorted(begins, at, "right") - 1

    def of(exact: str, prefix: str, suffix: str) -> tuple[int, int, int, int] | None:
        at, lines = met[exact], exact.count("\n")
        if lines:
            at = at[idx[node(at + len(exact))] - idx[node(at)] == lines]
        if len(at) > 1 and (prefix or suffix):
            agree = _agree(codes, at - 1, -1, _codes(prefix)[::-1]) + _agree(codes, at + len(exact), 1, _codes(suffix))
            at = at[agree == agree.max()]
        if len(at) != 1:
            return None
        a, b = int(at[0]), int(at[0]) + len(exact)
        i, j = int(node(a)), int(node(b))
        return int(idx[i]), a - int(begins[i]), int(idx[j]), b - int(begins[j])

    once = {x: of(*x) for x in set(quotes)}
    return [once[x] for x in quotes]


def _spans(text: pa.Scalar, idx: pa.Scalar, quotes: pa.Scalar) -> list[dict | None]:
    asked = quotes.values
    named = list(zip(*(asked.field(c).to_pylist() for c in ("exact", "prefix", "suffix")), strict=True))
    return [x and dict(zip(anchors.PLACE, x, strict=True)) for x in _best(text.as_py(), idx.values.to_numpy(), named)]


def found(quotes: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """``id`` and the span of the place in the nodes of its ``by`` where ``exact`` of a row of ``quotes`` occurs and ``prefix`` and ``suffix`` agree best.

    Rows without a place, or without one that agrees better than all others, are left out.
    """
    arrays.bounded(quotes.sparkSession)
    asked = F.struct("id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("exact", "prefix", "suffix")])
    wanted = quotes.where(F.replace("exact", F.lit("\n"), F.lit("")) != "").groupBy(by).agg(F.collect_list(asked).alias("asked"))
    lines = nodes.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("long").alias("idx"), F.coalesce("text", F.lit("")).alias("text")))).alias("lines"))
    spans = arrays.by_row(_spans, pa.list_(pa.struct([(c, pa.int64()) for c in anchors.PLACE])), f"array<struct<{','.join(f'{c}:bigint' for c in anchors.PLACE)}>>")
    told = lines.join(wanted, by).select("asked.id", spans(F.array_join("lines.text", "\n"), F.col("lines.idx"), F.col("asked")).alias("spans"))
    types = dict(nodes.dtypes)["idx"], "int"
    return told.select(F.explode(F.arrays_zip("id", "spans")).alias("x")).where("x.spans is not null").select("x.id", *[F.col(f"x.spans.{c}").cast(types[c.endswith("off")]).alias(c) for c in anchors.PLACE])


def resolved(stored: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """``id``, ``by``, ``status`` (``valid``, ``repaired``, ``unattached``) and the span that the anchor has now, null where unattached."""
    now = anchors.quotes(stored, nodes, by, 0).select("id", F.col("exact").alias("now"))
    held = kept(stored.join(now, "id", "left").withColumn("valid", F.coalesce(F.col("now") == F.coalesce("exact", F.lit("")), F.lit(False))))
    lost = held.where("not valid")
    again = lost.select("id", by).join(found(lost, nodes, by), "id", "left").select("id", by, F.when(F.col("start_idx").isNull(), "unattached").otherwise("repaired").alias("status"), *anchors.PLACE)
    return held.where("valid").select("id", by, F.lit("valid").alias("status"), *anchors.PLACE).unionByName(again)


def attached(noted: DataFrame, resolutions: DataFrame, created: str) -> tuple[DataFrame, DataFrame]:
    """``noted`` with the spans they have now and their ``place`` by ``created`` within ``version``, and those that are unattached."""
    shown = noted.drop(*anchors.PLACE).join(resolutions.where("status <> 'unattached'").select("id", *anchors.PLACE), "id")
    left = noted.join(resolutions.where("status = 'unattached'").select("id"), "id", "left_semi")
    return notes.exported(shown, created, include_imported=True), left


def positions(points: DataFrame, nodes: DataFrame, by: str, width: int = 1024) -> DataFrame:
    """``point``, ``by``, ``idx``, ``off``: the node and offset of a character ``at`` of the whole text, nodes joined by line ends.

    Nodes have ``begin``, where they begin in it. A line end is the place behind its node's last character; places outside
    the text give no row. Nodes and points meet in stretches of ``width`` characters.
    """
    dealt = nodes.select(by, "idx", F.col("begin").cast("long").alias("begin"), (F.col("begin") + F.length(F.coalesce("text", F.lit("")))).cast("long").alias("end"))
    stretch = lambda c: F.floor(F.col(c) / width)
    dealt = dealt.withColumn("stretch", F.explode(F.sequence(stretch("begin"), stretch("end"))))
    asked = points.select("point", by, F.col("at").cast("long").alias("at")).withColumn("stretch", stretch("at"))
    return asked.join(dealt, [by, "stretch"]).where("begin <= at and at <= end").select("point", by, "idx", (F.col("at") - F.col("begin")).cast("int").alias("off"))
