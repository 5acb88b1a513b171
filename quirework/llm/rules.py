"""Quality rules: exact rule statistics, and an isolation forest over them.

The forest's trees split rows of the whole table at random, 256 rows each and other rows for each tree;
documents that few splits separate from the rest have short paths and score as anomalous. The threshold on
that score is calibrated on all labelled rows: of all thresholds that reject at most ``spare`` of the good
rows, the one that rejects the most bad rows.

Null and empty texts have no words and fail the base rules. Statistics cover whole texts of any
length. Repeated rows get the same answer, null labels are ignored, and without labels of both
classes the forest rejects nothing. Extra columns are left alone.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, small

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(r"[A-ZÀ-Þ]")
_WINDOW = 5
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_distinct", "n_lines", "n_same_next")

#: The step of a rate in which the good rows do not differ: for words, 4 of 10,000.
_LEAST = 0.02
#: How many rates the forest looks at.
RATES = 6
#: Trees of the forest and rows of each.
TREES, SAMPLE = 200, 256


def statistics(text: str | None) -> tuple[int, ...]:
    """The counts named in ``STATS`` for one text."""
    text = text or ""
    found = _WORD.findall(text)
    n = len(found)
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if _WORD.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    windows = list(zip(*(found[k:] for k in range(_WINDOW)), strict=False))
    repeat = 0
    if len(set(windows)) < len(windows):
        times, covered = Counter(windows), 0
        for i, window in enumerate(windows):
            if times[window] > 1:
                repeat += i + _WINDOW - max(i, covered)
                covered = i + _WINDOW
    same = sum(map(operator.eq, found, found[1:]))
    return n, sum(map(len, found)), len(_SYMBOL.findall(text)), dup, repeat, len(_UPPER.findall(text)), len(set(found)), lines, same


def statistics_column(text: Column) -> Column:
    @F.pandas_udf(", ".join(f"{c} long" for c in STATS))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([statistics(t if isinstance(t, str) else None) for t in s], columns=list(STATS), dtype="int64")

    return of(text)


def rates(stats: pd.DataFrame) -> np.ndarray:
    """What the forest looks at, a row a document; none depends on a text's length as such."""
    n = np.maximum(stats["n_words"].to_numpy(float), 1)
    chars = np.maximum(stats["word_chars"].to_numpy(float), 1)
    lines = np.maximum(stats["n_lines"].to_numpy(float), 1)
    return np.column_stack([np.sqrt(stats["n_symbols"] / n), np.sqrt(stats["n_upper"] / chars), np.sqrt(stats["n_same_next"] / n), np.sqrt(stats["n_repeat_words"] / n), np.sqrt(stats["n_dup_lines"] / lines), np.log(chars / n)])


class Model:
    """A forest over rule levels, and the score above which rows go.

    A level counts, in steps of the good rows' own spread, how far a rate exceeds what all but a
    two-hundredth of them show. So rare but slight excesses of good rows do not isolate them, and
    however few rows exceed a rate, it counts. Where good rows do not spread, a step is ``_LEAST``.
    """

    def __init__(self, usual: np.ndarray, middle: np.ndarray, drawn: pd.DataFrame) -> None:
        self.usual, spread = usual, usual - middle
        self.step = np.where(spread > 0, spread, _LEAST)
        drawn = drawn[~base_failed(drawn)]
        self.forest = IsolationForest(self.levels(drawn)) if len(drawn) > 1 else None
        self.threshold = np.inf

    def levels(self, stats: pd.DataFrame) -> np.ndarray:
        return np.floor(np.maximum(rates(stats) - self.usual, 0) / self.step)

    def score(self, stats: pd.DataFrame) -> np.ndarray:
        return self.forest.score(self.levels(stats)) if self.forest and len(stats) else np.zeros(len(stats))

    def kept(self, stats: pd.DataFrame, score: np.ndarray) -> np.ndarray:
        return ~base_failed(stats).to_numpy() & ~(score > self.threshold)


class IsolationForest:
    """Random splits of ``sample`` rows a tree, other rows for each tree while there are enough, and the mean path length as a score from 0 to 1."""

    def __init__(self, x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 8) -> None:
        draw = np.random.default_rng(seed)
        self.size = min(sample, len(x))
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.size)))))
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.zeros((trees, nodes), np.int32)
        self.split = np.full((trees, nodes), np.inf)
        self.length = np.zeros((trees, nodes))
        dealt = draw.permutation(len(x))
        for t in range(trees):
            rows = dealt[t * sample : (t + 1) * sample] if len(x) >= trees * sample else draw.choice(len(x), self.size, replace=False)
            self._grow(t, 0, x[rows], 0, draw)

    def _grow(self, t: int, node: int, rows: np.ndarray, depth: int, draw: np.random.Generator) -> None:
        wide = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else ()
        if depth >= self.depth or not len(wide):
            self._leaf(t, node, depth, depth + average_path(len(rows)))
            return
        f = int(draw.choice(wide))
        at = draw.uniform(rows[:, f].min(), rows[:, f].max())
        self.feature[t, node], self.split[t, node] = f, at
        left = rows[:, f] <= at
        self._grow(t, 2 * node + 1, rows[left], depth + 1, draw)
        self._grow(t, 2 * node + 2, rows[~left], depth + 1, draw)

    def _leaf(self, t: int, node: int, depth: int, length: float) -> None:
        """A leaf's rows go left to the last level, whose nodes hold the path lengths."""
        for _ in range(self.depth - depth):
            node = 2 * node + 1
        self.length[t, node] = length

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.split)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.split[t, node])
            total += self.length[t, node]
        return 2.0 ** -(total / len(self.split) / max(average_path(self.size), 1e-9))


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary search tree of ``n`` rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def calibrate(score: np.ndarray, good: np.ndarray, bad: np.ndarray, spare: float) -> float:
    """The threshold (reject above it) that rejects the most bad rows and at most ``spare`` of the good; infinite if none does.

    ``good`` and ``bad`` say how many rows have each of the distinct scores.
    """
    if not good.sum() or not bad.sum():
        return np.inf
    order = np.argsort(-score)
    s, lost, caught = score[order], np.cumsum(good[order]), np.cumsum(bad[order])
    fits = np.flatnonzero((lost <= spare * good.sum()) & (caught > 0))
    if not len(fits):
        return np.inf
    best = fits[np.argmax(caught[fits] - lost[fits])]
    return float((s[best] + s[best + 1]) / 2) if best + 1 < len(s) else float(s[best]) - 1e-12


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", spare: float = 0.002) -> DataFrame:
    """``id_col``, the statistics, ``base_failed``, ``anomaly`` and ``kept`` for each row of ``docs``.

    ``labels`` has ``id_col`` and ``quality`` (1: good).
    """
    stats = cut(docs.select(id_col, statistics_column(F.col(text_col)).alias("s")).select(id_col, "s.*"))
    told = stats.join(marks(labels, id_col), id_col)
    model = stats.sparkSession.sparkContext.broadcast(fit(some(stats, TREES * SAMPLE), told, spare))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            score = model.value.score(rows)
            yield rows.assign(base_failed=base_failed(rows), anomaly=score, kept=model.value.kept(rows, score))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema)
    return stats.mapInPandas(of, f"{schema}, base_failed boolean, anomaly double, kept boolean")


def some(df: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows at most whose hash comes first, those of the whole table; a first pass by hash leaves few to sort."""
    n = df.count()
    h = F.xxhash64(F.lit(8), *df.columns)
    few = df if n <= most else df.where(F.pmod(h, F.lit(1_000_000_000)) < int(1_000_000_000 * min(1, 2 * most / n)))
    return few.orderBy(h).limit(most)


def marks(labels: DataFrame, id_col: str) -> DataFrame:
    return labels.where("quality is not null").select(id_col, F.col("quality").cast("int").alias("quality"))


def fit(drawn: DataFrame, told: DataFrame, spare: float) -> Model:
    """The trees' rows are ``drawn`` from the whole table; the good rows' quantiles and the threshold come from all labelled rows ``told``, counted per step."""
    told = cut(told.select(*STATS, "quality"))
    drawn = cut(drawn.select(*STATS))
    some_good = told.where("quality = 1").limit(1).count() > 0
    usual = quantiles(told.where("quality = 1") if some_good else drawn, (0.5, 0.995))
    model = Model(usual[1], usual[0], drawn.toPandas())
    shared = told.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows = rows[~base_failed(rows)]
            found = pd.DataFrame({"score": np.round(shared.value.score(rows), 4), "good": (rows["quality"] == 1).astype(int), "bad": (rows["quality"] != 1).astype(int)})
            yield found.groupby("score", as_index=False).sum()

    counted = told.mapInPandas(count, "score double, good long, bad long").groupBy("score").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toPandas()
    model.threshold = calibrate(counted["score"].to_numpy(), counted["good"].to_numpy(), counted["bad"].to_numpy(), spare)
    return model


def quantiles(stats: DataFrame, shares: tuple[float, ...], fine: int = 1_000) -> list[np.ndarray]:
    """Quantiles of each rate over all rows that pass the base rules, to ``1 / fine`` below; zero without such rows.

    Tasks count rows per step of ``1 / fine``, so what is shuffled and sent depends on the steps, not on the rows.
    """

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for rate, values in enumerate(rates(rows[~base_failed(rows)]).T):
                at, n = np.unique(np.floor(values * fine).astype(np.int64), return_counts=True)
                yield pd.DataFrame({"rate": rate, "step": at, "n": n})

    counted = stats.select(*STATS).mapInPandas(steps, "rate int, step long, n long").groupBy("rate", "step").agg(F.sum("n").alias("n"))
    found = {r["rate"]: r["at"] for r in counted.groupBy("rate").agg(F.percentile("step", list(shares), F.col("n")).alias("at")).collect()}
    return [np.array([found[k][i] / fine if k in found else 0.0 for k in range(RATES)]) for i in range(len(shares))]


def base_failed(stats: pd.DataFrame) -> pd.Series:
    return (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", spare: float = 0.002) -> DataFrame:
    """``docs`` without the rows that the rules or the forest reject, its columns as they are.

    The forest needs the statistics of the drawn and the labelled rows alone, so those of all rows are computed
    once, where they are judged. A row is judged by its own text, so ids may repeat or be null.
    """
    of = lambda df, *more: df.select(*more, statistics_column(F.col("text")).alias("s")).select(*more, "s.*")
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n = rows.count()
    h = F.pmod(F.xxhash64(F.lit(8), "id", "text"), F.lit(1_000_000_000))
    drawn = some(of(rows.where(h < int(1_000_000_000 * min(1, 1.5 * TREES * SAMPLE / max(n, 1)))), "id"), TREES * SAMPLE)
    known = marks(labels.withColumnRenamed(id_col, "id"), "id")
    told = of(rows.join(F.broadcast(known) if small(known, 1_000_000) else known, "id"), "quality")
    model = docs.sparkSession.sparkContext.broadcast(fit(drawn, told, spare))

    @F.pandas_udf("boolean")
    def keep(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = pd.DataFrame([statistics(t if isinstance(t, str) else None) for t in texts], columns=list(STATS), dtype="int64")
            yield pd.Series(model.value.kept(rows, model.value.score(rows)))

    return docs.where(keep(F.col(text_col)))
